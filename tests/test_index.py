"""The incremental index against whole runs, and what two writers at once publish."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from linkgrain.operators import extract, index
from linkgrain.sources import snapshots


def indexed(spark, texts, **more):
    files = spark.createDataFrame(sorted(texts.items()), "path string, text string")
    found = extract.symbols(files.withColumn("language", F.lit("python")))
    return index.run(files, found.withColumn("id", F.concat_ws(":", "name", "s")), **more)


def rows(df, *columns):
    return sorted(map(repr, map(tuple, df.select(*columns).collect())))


def state(found, active_only=True):
    nodes = found.nodes.filter("active") if active_only else found.nodes
    return rows(nodes, "trace_id", "node_type", "path", "s", "e", "fingerprint", "attachment"), rows(found.edges, "f", "p", "t", "kind", "path", "line"), rows(found.findings, *found.findings.columns)


def test_any_sequence_of_changes_equals_a_whole_run(spark):
    rng = random.Random(11)
    made = lambda i: f"# trace:v1 id=impl.n{i} work=WORK-{rng.randrange(3)} depends_on=impl.n{rng.randrange(8)}" + rng.choice(["", " odd=1", " title=a title=b"]) + f"\ndef f{i}():\n    return {rng.randrange(5)}\n"
    texts = {f"src/f{i}.py": made(i) for i in range(5)}
    now = indexed(spark, texts)
    for turn in range(3):
        touched = set()
        for path in rng.sample(sorted(texts), 2):
            kind = rng.choice(["edit", "delete", "rename", "break"])
            old = texts.pop(path)
            touched.add(path)
            if kind == "edit":
                texts[path] = made(int(path[5:-3]))
            elif kind == "rename":
                path = f"lib/r{turn}-{path[5:]}"
                texts[path] = old
                touched.add(path)
            elif kind == "break":
                texts[path] = old.replace("id=", 'note="')
        paths = spark.createDataFrame([(p,) for p in sorted(touched)], "path string")
        files = {p: t for p, t in texts.items() if p in touched} or {"none": ""}
        now = indexed(spark, files, previous=now, changed_paths=paths, at=str(turn + 1))
        # The whole run sees only what there is; what was deleted counts as missing either way.
        assert state(now) == state(indexed(spark, texts))


def test_findings_of_unchanged_files_stay(spark):
    one = indexed(spark, {"a.py": "# trace:v1 id=impl.a odd=1\n", "b.py": "# trace:v1 id=impl.b work=WORK-1\n"})
    two = indexed(spark, {"b.py": "# trace:v1 id=impl.b\n"}, previous=one, changed_paths=spark.createDataFrame([("b.py",)], "path string"))
    assert rows(one.findings, "rule", "path", "detail") == ["('TL002', 'b.py', 'impl.b work -> WORK-1')", "('TL040', 'a.py', 'unknown odd')"]
    assert rows(two.findings, "rule", "path", "detail") == ["('TL040', 'a.py', 'unknown odd')"]


def test_inactive_nodes_and_statuses(spark):
    paths = spark.createDataFrame([("b.py",)], "path string")
    one = indexed(spark, {"a.py": "# trace:v1 id=impl.a depends_on=impl.b\n", "b.py": "# trace:v1 id=impl.b\ndef b(): return 1\n"})
    two = indexed(spark, {"b.py": "# trace:v1 id=impl.b\ndef b(): return 2\n"}, previous=one, changed_paths=paths, at="1")
    assert rows(two.nodes, "trace_id", "status", "changed", "evidence_status") == ["('impl.a', 'stale_review_required', False, 'historical_not_current')", "('impl.b', 'current', True, None)"]
    # What was reviewed stays so while nothing that it rests on has another version.
    nodes = one.nodes.withColumn("status", F.when(F.col("trace_id") == "impl.a", "reviewed_needs_verification").otherwise(F.col("status")))
    same = indexed(spark, {"b.py": "# trace:v1 id=impl.b\ndef b(): return 1\n"}, previous=index.Index(nodes, one.edges, one.versions, one.findings), changed_paths=paths)
    assert rows(same.nodes, "trace_id", "status") == ["('impl.a', 'reviewed_needs_verification')", "('impl.b', 'current')"]
    gone = indexed(spark, {"none": ""}, previous=two, changed_paths=paths, at="2")
    assert rows(gone.nodes, "trace_id", "active") == ["('impl.a', True)", "('impl.b', False)"] and rows(gone.findings, "rule", "trace_id", "path", "line") == ["('TL002', None, 'a.py', 1)"]
    again = indexed(spark, {"none": ""}, previous=gone, changed_paths=paths, at="3")
    assert rows(again.nodes, "trace_id") == ["('impl.a',)"]
    whole = indexed(spark, {"c.py": "# trace:v1 id=impl.c\n"}, previous=gone, at="4")
    assert rows(whole.nodes, "trace_id", "active") == ["('impl.a', False)", "('impl.b', False)", "('impl.c', True)"] and whole.edges.count() == 0


def test_of_two_writers_one_publishes(spark, tmp_path):
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, root, "a")
    table = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    assert snapshots.publish({"a": table(1), "b": table(10)}, root, 0) == 1
    a, b = snapshots.read(spark, root, "a", "b")
    results = []

    def write(x):
        try:
            results.append(snapshots.publish({"a": table(x), "b": table(10 * x)}, root, 1))
        except snapshots.Superseded:
            results.append("told")

    writers = [threading.Thread(target=write, args=(x,)) for x in (2, 3, 4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(results, key=str) == [2, "told", "told"]
    now = [t.first().x for t in snapshots.read(spark, root, "a", "b")]
    assert now[1] == 10 * now[0] and now[0] in (2, 3, 4) and (a.first().x, b.first().x) == (1, 10)
    add = lambda tables: {n: t.unionByName(table(7)) for n, t in tables.items()}
    assert snapshots.updated(spark, root, ("a", "b"), add) == 3
    assert sorted(r.x for r in snapshots.read(spark, root, "a")[0].collect()) == sorted([now[0], 7])


def test_symbols_are_computed_once(spark):
    reads = spark.sparkContext.accumulator(0)
    files = spark.createDataFrame([(f"{n}.py", f"# trace:v1 id=impl.n{n} work=WORK-1\ndef f():\n    pass\n") for n in range(4)], "path string, text string")
    found = spark.createDataFrame([(f"{n}.py", "f", 2, 3, "h", "ast") for n in range(4)], "path string, id string, s int, e int, hash string, parser string")
    found = found.withColumn("s", F.udf(lambda s: reads.add(1) or s, "int")("s"))
    one = index.run(files, found)
    assert rows(one.nodes, "trace_id", "s", "attachment") == [f"('impl.n{n}', 2, 'symbol')" for n in range(4)]
    assert rows(one.edges, "f", "t", "line") == [f"('impl.n{n}', 'WORK-1', 1)" for n in range(4)]
    assert reads.value == 4

"""Work that grows with the rows, and not with the pairs of them, and the results of that work against plain Python."""

import random
import time

import pytest
from pyspark.sql import functions as F

from linkgrain.operators import boundaries, history, index, search, structure

N = 100_000


@pytest.fixture(scope="module")
def crowd(spark):
    """Very many spans and points of one file on few lines."""
    spans = spark.range(N).select(F.lit("p").alias("path"), F.concat(F.lit("i"), F.lpad("id", 6, "0")).alias("id"), F.lit(10).alias("s"), (F.col("id") % 2 + 20).cast("int").alias("e"))
    points = spark.range(N).select(F.lit("p").alias("path"), (F.col("id") % 2 + 9).cast("int").alias("line"), F.col("id").alias("point"))
    return spans, points


def quick(df, seconds=60):
    start = time.monotonic()
    rows = df().collect()
    assert time.monotonic() - start < seconds
    return rows


def test_crowded_lines(crowd):
    spans, points = crowd
    assert {r.id for r in quick(lambda: structure.narrowest(points, spans))} == {"i000000"}
    assert {(r.point % 2, r.id) for r in quick(lambda: structure.node_at_line(points, spans))} == {(0, "i000000"), (1, "i099999")}
    assert {r.lines for r in quick(lambda: structure.covered_lines(points, spans).select("lines").distinct())} == {N // 2}
    ranges = points.select("path", F.col("point").alias("rid"), F.col("line").alias("s"), F.col("line").alias("e"))
    assert quick(lambda: structure.overlapping(ranges, spans).groupBy("id").count()) == [("i000000", N // 2)]
    assert quick(lambda: structure.intersecting(spans, ranges).groupBy().count())[0][0] == N
    added = spans.select("path", F.col("s").alias("line")).distinct()
    assert quick(lambda: structure.unmarked(spans, added, points.select("path", "line"))) == []
    marks = points.withColumnRenamed("point", "marker")
    lines = points.sparkSession.createDataFrame([("p", 11, False)], "path string, line int, skippable boolean")
    assert quick(lambda: structure.following(marks, spans, lines).groupBy("id", "ambiguous").count()) == [("i000000", True, N // 2)]


def test_boundaries_on_the_same_lines(crowd):
    spans, _ = crowd
    marked = spans.select("path", F.col("id").alias("name"), "s", "e", F.col("id").alias("traced_by"))
    rows = quick(lambda: boundaries.enclosing(marked).groupBy("parent", "traced_by", "oe").count())
    assert sorted(rows) == [("i000000", "i000000", 20, N // 2 - 1), ("i000001", "i000001", 21, N // 2 - 1), ("i000002", "i000002", 20, 1), ("i000003", "i000003", 21, 1)]


def test_spans_against_plain_python(spark):
    rng = random.Random(3)
    spans = [("p", f"i{n}", s := rng.randrange(0, 140), s + rng.choice((0, 1, 2, 7, 15, 16, 63, 64, 90))) for n in range(60)]
    points = [("p", rng.randrange(0, 150), n) for n in range(80)]
    ranges = [("p", n, s := rng.randrange(0, 220), s + rng.randrange(0, 9)) for n in range(60)]
    ds = spark.createDataFrame(spans, "path string, id string, s int, e int")
    dp = spark.createDataFrame(points, "path string, line int, point long")
    dr = spark.createDataFrame(ranges, "path string, rid long, s int, e int")
    on = {n: [x for x in spans if x[2] <= at <= x[3]] for _, at, n in points}
    assert {r.point: r.id for r in structure.narrowest(dp, ds).collect()} == {n: min((x[3] - x[2], x[2], x[1]) for x in xs)[2] for n, xs in on.items() if xs}
    first = min((x[2], x[1]) for x in spans)[1]
    assert {r.point: r.id for r in structure.node_at_line(dp, ds).collect()} == {n: max((x[2], x[1]) for x in xs)[1] if xs else first for n, xs in on.items()}
    assert {r.id: r.lines for r in structure.covered_lines(dp, ds).collect()} == {x[1]: c for x in spans if (c := sum(x[2] <= at <= x[3] for _, at, _ in points))}
    meets = {r[1]: [x[1] for x in spans if x[2] <= r[3] and x[3] >= r[2]] for r in ranges}
    assert {r.rid: r.id for r in structure.overlapping(dr, ds).collect()} == {n: min(xs) for n, xs in meets.items() if xs}
    some = ranges[:3]
    hit = structure.intersecting(ds, spark.createDataFrame([(p, s, e) for p, _, s, e in some], "path string, s int, e int"))
    assert sorted(r.id for r in hit.collect()) == sorted(x[1] for x in spans if any(x[2] <= e and s <= x[3] for _, _, s, e in some))
    assert sorted(structure.containment(ds).collect()) == sorted((a[1], b[1]) for a in spans for b in spans if a[2] < b[2] and a[3] > b[3])
    held = {r.name: (r.parent, r.os, r.oe) for r in boundaries.enclosing(ds.select("path", F.col("id").alias("name"), "s", "e", F.col("id").alias("traced_by"))).collect()}
    around = {b[1]: [(a[3] - a[2], a[2], a[1], a[3]) for a in spans if a[2] <= b[2] and a[3] >= b[3] and a[1] != b[1]] for b in spans}
    assert held == {n: (m[2], m[1], m[3]) for n, xs in around.items() if xs for m in [min(xs)]}


def test_sections_of_a_marker_on_two_lines(spark):
    marks = spark.createDataFrame([("p", 1, 5), ("p", 2, 5), ("p", 2, 40)], "path string, marker int, line int")
    sections = spark.createDataFrame([("p", "a", 1, 50), ("p", "b", 4, 6), ("p", "c", 39, 41)], "path string, key string, s int, e int")
    assert sorted(structure.sections_at(marks, sections).collect()) == [("p", 1, "a", 1), ("p", 1, "b", 2), ("p", 2, "a", 1), ("p", 2, "a", 2), ("p", 2, "b", 3), ("p", 2, "c", 4)]


def test_rounds_of_a_long_chain_of_renames(spark, monkeypatch):
    commits = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(60)] + [("n60", "n0"), ("x", "y")], "path string, old_path string")
    made = []
    monkeypatch.setattr(history, "kept", lambda df, name, kept=history.kept: made.append(name) or kept(df, name))
    got = history.names(spark.createDataFrame([("n0",), ("z",)], "path string"), commits)
    assert sorted(got.collect()) == sorted([("n0", f"n{i}") for i in range(61)] + [("z", "z")])
    assert len(made) < 20


def test_structural_edges_are_not_kept(spark, monkeypatch):
    made = []
    monkeypatch.setattr(index, "kept", lambda df, name, kept=index.kept: made.append(kept(df, name)) or made[-1])
    files = spark.createDataFrame([("a.py", "# trace:v1 id=impl.a\nclass A:\n    # trace:v1 id=impl.b\n    def b():\n        pass\n")], "path string, text string")
    symbols = spark.createDataFrame([("a.py", "A", 2, 5, "h", "ast"), ("a.py", "b", 4, 5, "g", "ast")], "path string, id string, s int, e int, hash string, parser string")
    index.run(files, symbols).edges.collect()
    assert not [r for df in made if "kind" in df.columns for r in df.filter("kind = 'structural'").collect()]


def test_ties_to_nine_places_go_to_the_smaller_id(spark, tmp_path):
    words = {1: "the the of", 2: "the of of", 3: "of the the x", 4: "the"}
    docs = spark.createDataFrame([(n, " ".join([words[n % 4 + 1]] * (n % 7 + 1))) for n in range(90)], "id long, text string")
    own = search.StoredIndex(spark, str(tmp_path / "i"), ["text"])
    own.update(docs)
    asked = spark.createDataFrame([("a", "the of"), ("b", "of the"), ("c", "of none"), ("d", "x")], "query string, text string")
    rows = own.best(asked, 15).collect()
    assert {r["query"] for r in rows} == {"a", "b", "d"}
    for q in "abd":
        own_rows = sorted((r["rank"], round(r["score"], 9), r["id"]) for r in rows if r["query"] == q)
        assert [x[0] for x in own_rows] == list(range(1, 16))
        assert [x[1:] for x in own_rows] == sorted(x[1:] for x in own_rows)


def test_lines_and_ranges_are_not_sent_through_the_driver(spark, crowd):
    """Packed they are under any limit of size: here all of them would be broadcast."""
    spans, points = crowd
    for made in (structure.covered_lines(points, spans), structure.unmarked(spans, spans.select("path", F.col("s").alias("line")), points.select("path", "line")), structure.narrowest(points, spans), structure.overlapping(points.select("path", F.col("point").alias("rid"), F.col("line").alias("s"), F.col("line").alias("e")), spans)):
        made.collect()
        assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()

"""The stored search index after updates, depth-first paths under bounds, impact parts, requests, coverage contexts."""

import random

import pytest
from pyspark.sql import functions as F

from linkgrain import session
from linkgrain.functions.ids import node_uid
from linkgrain.operators import evidence, graph, search, tasks
from linkgrain.sources import snapshots


def test_stored_index_equals_the_scan_after_updates(spark, tmp_path):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "the", "the"]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 9)))
    docs = {i: text() for i in range(60)}
    table = lambda d: spark.createDataFrame(sorted(d.items()), "id int, text string")
    index = search.StoredIndex(spark, str(tmp_path / "i"), ["text"])
    index.update(table(docs))
    changed = {i: text() for i in (3, 7, 61, 62)}
    index.update(table(changed), spark.createDataFrame([(9,), (10,)], "id int"))
    docs = {i: t for i, t in (docs | changed).items() if i not in (9, 10)}
    asked = ["the alpha", "alpha", "beta gamma the", "nothing", "alpha nothing", "eps!", "DELTA"]
    queries = spark.createDataFrame([(str(i), q) for i, q in enumerate(asked)], "query string, text string")
    got = {}
    for r in index.best(queries, 5).collect():
        got.setdefault(r.query, []).append((r.rank, r.id, round(r.score, 9)))
    for i, q in enumerate(asked):
        scan = [(k + 1, r.id, round(r.score, 9)) for k, r in enumerate(search.bm25(table(docs), ["text"], q, 5).collect())] if q != "eps!" else []
        assert sorted(got.get(str(i), [])) == scan
    assert index.best(queries.limit(0)).count() == 0 and snapshots.current(spark, index.root)[0] == 2


def test_a_search_reads_only_its_terms_folders(spark, tmp_path):
    index = search.StoredIndex(spark, str(tmp_path / "i"), ["text"])
    index.update(spark.createDataFrame([(i, f"w{i} common") for i in range(200)], "id int, text string"))
    plan = index.postings([5, 9])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:120]


def test_queries_without_ranked_hits_go_by_substring(spark, tmp_path):
    index = search.StoredIndex(spark, str(tmp_path / "i"), ["name", "title"])
    index.update(spark.createDataFrame([("a", "impl.auth-token", "Rotate"), ("b", "impl.auth", "Keep Tokens"), ("c", "x", "y%z")], "id string, name string, title string"))
    queries = spark.createDataFrame([("1", "impl.auth"), ("2", "OKEN"), ("3", "y%"), ("4", "rotate"), ("5", " "), ("6", "x"), ("7", "auth-tokens")], "query string, text string")
    found = {}
    for r in index.found(queries, 2).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append(r.id)
    assert found == {"1": ["a", "b"], "2": ["a", "b"], "3": ["c"], "4": ["a"], "6": ["c"]}


# ---------------------------------------------------------------- why

RANK = {p: i for i, p in enumerate(graph.WHY_PREDICATES)}


def plain_paths(start, kinds, out, uid, hops=8, expansions=200, cap=20):
    spent = [0]

    def paths(node, stack):
        if len(stack) > hops or spent[0] >= expansions:
            return [[]]
        found = []
        for p, t in sorted(out.get(node, ()), key=lambda m: (RANK[m[0]], uid[m[1]])):
            if t in stack or t not in kinds:
                continue
            spent[0] += 1
            for rest in paths(t, stack | {t}):
                found.append([t, *rest])
                if len(found) >= cap:
                    return found
        return found or [[]]

    return sorted({"-".join([*reversed(p), start]) for p in paths(start, {start}) if p})


@pytest.mark.parametrize(("n", "m", "seed"), [(30, 200, 1), (60, 160, 2), (12, 90, 3)])
def test_bounds_of_a_dense_graph_cut_as_a_depth_first_search_does(spark, n, m, seed):
    rng = random.Random(seed)
    ids = [f"x{i}" for i in range(n)]
    kinds = {i: rng.choice(["work", "requirement", "plan", "implementation", "goal"]) for i in ids if i != "x5"}
    edges = sorted({(rng.choice(ids), rng.choice(graph.WHY_PREDICATES), rng.choice(ids)) for _ in range(m)})
    out = {}
    for f, p, t in edges:
        if f != t:
            out.setdefault(f, set()).add((p, t))
    uid = {r.i: r.u for r in spark.createDataFrame([(i,) for i in ids], "i string").select("i", node_uid(F.col("i")).alias("u")).collect()}
    starts = ids[:4]
    nodes = spark.createDataFrame(sorted(kinds.items()), "trace_id string, node_type string")
    rows = graph.why_paths(spark.createDataFrame([(i,) for i in starts], "trace_id string"), nodes, spark.createDataFrame(edges, "f string, p string, t string"), max_paths=5)
    got = {}
    for r in rows.collect():
        got.setdefault(r.trace_id, set()).add(r.chain)
    cut = 0
    for s in starts:
        every = plain_paths(s, kinds, out, uid)
        cut += len(every) >= 15
        assert got.get(s, set()) <= set(every) and len(got.get(s, ())) == min(5, len(every))
    # All candidates, not only the best ones.
    rows = graph.why_paths(spark.createDataFrame([(starts[0],)], "trace_id string"), nodes, spark.createDataFrame(edges, "f string, p string, t string"), max_paths=1000, factor=1, expansions=50)
    assert sorted(r.chain for r in rows.collect()) == plain_paths(starts[0], kinds, out, uid, expansions=50, cap=1000) and (cut or n == 12)


def test_impact_parts(spark):
    nodes = spark.createDataFrame([("REQ-1", "requirement", "r.md", "current"), ("impl.a", "implementation", "a.py", "stale_review_required"), ("test.a", "test", "t.py", "current"), ("impl.o", "implementation", "a.py", "reviewed_needs_verification")], "trace_id string, node_type string, path string, status string")
    edges = spark.createDataFrame([("impl.a", "satisfies", "REQ-1"), ("test.a", "exercises", "impl.a"), ("impl.o", "contains", "impl.a"), ("impl.o", "calls", "REQ-1")], "f string, p string, t string")
    commits = spark.createDataFrame([("r.md", "c1", "x", "d", "s", 1, None), ("r.md", "c2", "x", "d", "s", 2, "old.md"), ("old.md", "c0", "x", "d", "s", 0, None), ("a.py", "c9", "x", "d", "s", 9, None)], "path string, sha string, author string, date string, summary string, seq int, old_path string")
    rows = graph.impact_summary(spark.createDataFrame([("REQ-1",)], "trace_id string"), nodes, edges, commits, most_commits=2)
    assert sorted(map(tuple, rows.collect())) == [
        ("history", "r.md", 1, "c2"), ("history", "r.md", 2, "c1"), ("semantic", "impl.a", 1, "implementation"), ("semantic", "test.a", 2, "test"),
        ("stale", "impl.a", 1, "stale_review_required"), ("stale", "impl.o", 1, "reviewed_needs_verification"), ("structural", "impl.o", 1, "implementation"), ("test", "test.a", 2, "current"),
    ]


def test_sessions_and_sources(spark):
    work = spark.createDataFrame([("WORK-1", "rotate refresh tokens", "done", [("REQ-1", "token rotation")], None, False, False), ("WORK-2", "billing export", "active", [("REQ-3", "csv"), ("REQ-2", "export")], None, True, False)], "trace_id string, title string, status string, reqs array<struct<id: string, title: string>>, boundary string, changed boolean, recent boolean")
    prompts = spark.createDataFrame([("1", "rotate them", None, "WORK-1"), ("2", "billing export csv", None, "WORK-1"), ("3", "do this", None, "WORK-9"), ("4", "paint the wall", None, "WORK-1"), ("5", " ", None, "WORK-1"), ("6", "again", None, "WORK-2"), ("7", "its own wall", None, "WORK-1")], "prompt string, text string, branch string, active string")
    hits = spark.createDataFrame([("4", "REQ-2")], "prompt string, trace_id string")
    got = {r.prompt: (r.work, r.confidence, r.requirements, r.sources) for r in tasks.resolved(prompts, work, hits).collect()}
    assert got == {
        "1": ("WORK-1", 1.0, ["REQ-1"], ["active_session"]), "2": ("WORK-2", 1.0, ["REQ-2", "REQ-3"], ["work_title", "requirement_title", "changed_boundaries", "open_work"]), "3": ("WORK-9", 1.0, [], ["active_session"]),
        "4": ("WORK-2", 1.0, ["REQ-2", "REQ-3"], ["fts", "changed_boundaries", "open_work"]), "5": (None, 0.0, [], []), "6": ("WORK-2", 1.0, ["REQ-2", "REQ-3"], ["active_session"]), "7": ("WORK-2", 0.7, ["REQ-2", "REQ-3"], ["changed_boundaries", "open_work"]),
    }


def test_coverage_contexts(spark):
    bits = spark.createDataFrame([("t.a|run", "a.py", bytearray([0b00000110, 0b1, 0x80])), ("t.a|setup", "a.py", bytearray([0b1000])), ("", "a.py", bytearray([255])), ("t.b", "b.py", bytearray([0])), ("t.c|run", "a.py", bytearray(400) + bytearray([1])), ("t.d", None, None)], "context string, path string, numbits binary")
    runs = evidence.context_lines(bits)
    assert sorted(map(tuple, runs.collect())) == [("t.a", "a.py", 1, 2), ("t.a", "a.py", 3, 3), ("t.a", "a.py", 8, 8), ("t.a", "a.py", 23, 23), ("t.c", "a.py", 3200, 3200)]
    impls = spark.createDataFrame([("a.py", "impl.a", 2, 10), ("a.py", "impl.wide", 1, 5000), ("b.py", "impl.b", 1, 9)], "path string, id string, s int, e int")
    assert sorted(map(tuple, evidence.context_edges(runs, impls).collect())) == [("t.a", "impl.a", 3), ("t.a", "impl.wide", 5), ("t.c", "impl.wide", 1)]


def test_a_session_searches_its_stored_index(spark, tmp_path):
    nodes = lambda *ids: spark.createDataFrame([(i, "implementation", f"{i}.py", "current", True) for i in ids], "trace_id string, node_type string, path string, status string, active boolean")
    edges = spark.createDataFrame([], "f string, p string, t string, status string")
    session.Traceability(nodes("impl.one", "impl.two"), edges).write(str(tmp_path), "1")
    session.Traceability(nodes("impl.two", "impl.three"), edges).write(str(tmp_path), "2")
    own = session.Traceability.read(spark, str(tmp_path))
    assert [r.id for r in own.search("impl").collect()] == ["impl.three", "impl.two"] and own.search("one").count() == 0 and [r.id for r in own.search("l.th").collect()] == ["impl.three"]


def test_index_counts_words_without_comparators(spark, tmp_path, monkeypatch):
    """Words are sorted natively, a document's length asks for no order, and a search reads lengths with the postings."""
    plans = []
    own = search.StoredIndex(spark, str(tmp_path / "i"), ["text"])
    monkeypatch.setattr(search.snapshots, "publish", lambda tables, *a, f=search.snapshots.publish: plans.append(tables["documents"]._jdf.queryExecution().optimizedPlan().toString()) or f(tables, *a))
    rng = random.Random(2)
    texts = {n: " ".join(rng.choice(["a", "b", "ab", "A", "é", "9"]) for _ in range(rng.randrange(12))) for n in range(200)} | {200: "", 201: "a"}
    own.update(spark.createDataFrame(list(texts.items()), "id long, text string"))
    assert "sort" not in plans[0].lower()
    words = {n: [w for w in t.lower().split() if w != "é"] for n, t in texts.items()}
    want = sorted((n, w, ws.count(w), len(ws)) for n, ws in words.items() for w in set(ws))
    assert sorted(tuple(r[c] for c in ("id", "term", "n", "length")) for r in own.postings(list(range(search.BUCKETS))).collect()) == want

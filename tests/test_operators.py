"""Single operators on small graphs: what they flag, what they leave, what is out of scope."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkgrain import session
from linkgrain.functions import ids, text
from linkgrain.functions.lexing import declarations
from linkgrain.operators import boundaries, change, doctor, evidence, extract, graph, index, reports, rules, search, structure, tasks
from linkgrain.plans import policy
from linkgrain.sources import readers

NODE = "trace_id string, node_type string, path string, s int, e int, status string, active boolean"


def nodes(spark, *rows):
    return spark.createDataFrame([(r + (None,) * 7)[:7] for r in rows], NODE)


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "f string, p string, t string")


@pytest.fixture
def ctx(spark):
    n = nodes(
        spark, ("REQ-1", "requirement", "r.md", 1, 5, "current", True), ("REQ-2", "requirement", "r.md", 6, 9, "current", True), ("REQ-3", "requirement", "r.md", 6, 9, "current", False),
        ("impl.a", "implementation", "a.py", 1, 9, "stale_review_required", True), ("impl.b", "implementation", "b.py", 1, 9, "current", True), ("test.a", "test", "t.py", 1, 3, "current", True), ("PLAN-1", "plan", "p.md", 1, 2, "current", True),
    )
    e = edges(spark, ("impl.a", "satisfies", "REQ-1"), ("test.a", "verifies", "REQ-1"), ("test.a", "exercises", "impl.a"), ("impl.b", "depends_on", "REQ-3"), ("impl.a", "implements", "PLAN-9"))
    return rules.Context(n, e)


def found(df):
    return [] if df is None else sorted(r["trace_id"] or r["path"] for r in df.collect())


def test_rule_hits_and_misses(ctx):
    assert found(rules.missing_target(ctx)) == ["impl.a"]
    assert found(rules.no_ancestry(ctx)) == ["impl.b"]
    assert found(rules.stale_downstream(ctx)) == ["REQ-1"]
    assert found(rules.unverified(ctx)) == ["REQ-2"]
    assert found(rules.deleted_but_linked(ctx)) == ["REQ-3"]


def test_rules_respect_scope(spark, ctx):
    ctx.scope = spark.createDataFrame([("REQ-1",), ("impl.a",)], "trace_id string")
    assert found(rules.no_ancestry(ctx)) == []
    assert found(rules.unverified(ctx)) == []
    assert found(rules.deleted_but_linked(ctx)) == []


def test_changed_paths(spark, ctx):
    assert rules.unclaimed_path(ctx) is None
    ctx.changed_paths = spark.createDataFrame([("a.py",), ("new.py",), ("docs/x/y.md",), (".trace/policy.toml",), ("docs2/policy.toml",)], "path string")
    ctx.exclusions = ["docs/*"]
    assert found(rules.unclaimed_path(ctx)) == [".trace/policy.toml", "docs2/policy.toml", "new.py"]
    assert found(rules.enforcement_changed(ctx)) == [".trace/policy.toml"]


def test_plan_gaps(spark, ctx):
    ctx.expects = spark.createDataFrame([("PLAN-1", "impl.a"), ("PLAN-1", "impl.zzz")], "plan string, expected string")
    assert sorted(r["detail"] for r in rules.plan_gap(ctx).collect()) == ["impl.a unlinked", "impl.zzz missing"]


def test_bound_result_beats_named(spark, ctx):
    ctx.runs = spark.createDataFrame([("r1", "2024-01-01", "x"), ("r2", "2024-01-02", "x")], "run_id string, started_at string, revision string")
    ctx.results = spark.createDataFrame([("r2", "test.a", None, "fail"), ("r2", "zz", "test.a", "pass"), ("r1", "q", "test.a", "fail")], "run_id string, fid string, test string, outcome string")
    assert found(rules.test_not_passed(ctx)) == []
    ctx.results = ctx.results.filter("test is null")
    assert found(rules.test_not_passed(ctx)) == ["test.a"]


def test_proof_levels(spark):
    x = spark.createDataFrame([("r", "t1", "i1", "per_test", True), ("r", "t2", "i1", "suite", False), ("r", "suite", "i2", "suite", False)], "run_id string, test string, impl string, kind string, behavioral boolean")
    pairs = spark.createDataFrame([("t1", "i1"), ("t2", "i1"), ("t9", "i2"), ("t9", "i3")], "test string, impl string")
    assert {(r.test, r.impl): r.level for r in rules.proof_levels(pairs, x).collect()} == {("t1", "i1"): 3, ("t2", "i1"): 2, ("t9", "i2"): 1, ("t9", "i3"): 0}


def test_waivers_and_blocking(spark, ctx):
    w = spark.createDataFrame([("TL020", "REQ-2", None, "me", "2030-01-01", 0)], "rule string, trace_id string, path string, owner string, expires string, pos int").withColumn("expires", F.col("expires").cast("date"))
    rows = policy.waived(rules.unverified(ctx), w, "2024-02-01")
    assert [(r.severity, r.waiver) for r in rows.collect()] == [("INFO", "me")]
    assert not policy.blocking(rows).first().blocking
    assert policy.blocking(policy.waived(rules.unverified(ctx), w, "2031-01-01")).first().blocking


def test_profiles():
    assert "TL010" not in policy.enabled("standard", "wip") and "TL010" in policy.enabled("standard", "merge")
    assert "TL110" not in policy.enabled("minimal", "release") and "TL060" in policy.enabled("strict", "release")
    assert "TL022" in policy.enabled("safety-critical", "draft") and "TL020" in policy.enabled("minimal", "wip", {"verifying_test": True})
    assert policy.enabled("unknown", "wip") == policy.enabled("minimal", "wip")


def test_unknown_profile_is_told(ctx):
    rows = policy.evaluate(ctx, "odd").collect()
    assert [(r.rule, r.severity, r.detail) for r in rows if r.rule == "TL100"] == [("TL100", "ERROR", "unknown profile odd")]
    assert {r.rule for r in rows} == {"TL002", "TL100"} and "TL100" not in {r.rule for r in policy.evaluate(ctx, "minimal").collect()}


def test_missing_targets_stand_where_they_are_declared(ctx):
    ctx.edges = ctx.edges.withColumns({"path": F.concat("p", F.lit(".md")), "line": F.length("t")})
    assert [(r.trace_id, r.path, r.line) for r in rules.missing_target(ctx).collect()] == [("impl.a", "implements.md", 6)]


def test_walk_bounds(spark):
    n = nodes(spark, *[(x,) for x in "abcde"])
    e = edges(spark, ("a", "work", "b"), ("b", "work", "c"), ("c", "work", "a"), ("c", "blocks", "d"), ("d", "work", "zz"), ("e", "work", "e"))
    start = spark.createDataFrame([("a",)], "trace_id string")
    depth = lambda **k: {r.trace_id: r.depth for r in graph.walk(start, n, e, **k).collect()}
    assert depth() == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert depth(depth=1) == {"a": 0, "b": 1}
    assert depth(direction="in", predicates=["work"]) == {"a": 0, "c": 1, "b": 2}
    assert depth(max_nodes=2) == {"a": 0, "b": 1}
    assert graph.walk(spark.createDataFrame([("none",)], "trace_id string"), n, e).count() == 0
    with pytest.raises(ValueError, match="direction"):
        depth(direction="up")
    reached = graph.walk(start, n, e)
    assert graph.tree("a", reached, graph.steps(e, "out")).splitlines() == ["a", "  work b", "    work c", "      blocks d", "        work zz", "      work a *"]


def test_why_ranks_and_survives_cycles(spark):
    n = nodes(spark, ("impl.x", "implementation"), ("REQ-1", "requirement"), ("PRD-1", "prd"), ("WORK-1", "work"), ("ADR-1", "decision"))
    e = edges(spark, ("impl.x", "satisfies", "REQ-1"), ("REQ-1", "derived_from", "PRD-1"), ("PRD-1", "derived_from", "REQ-1"), ("REQ-1", "work", "WORK-1"), ("impl.x", "addresses", "ADR-1"))
    rows = graph.why_paths(spark.createDataFrame([("impl.x",)], "trace_id string"), n, e).orderBy("rank").collect()
    assert [(r.chain, r.score) for r in rows] == [("WORK-1-REQ-1-impl.x", 194), ("PRD-1-REQ-1-impl.x", 90), ("ADR-1-impl.x", 81)]
    assert len(graph.why_paths(spark.createDataFrame([("impl.x",)], "trace_id string"), n, e, max_paths=0).collect()) == 1


def test_search_falls_back(spark):
    docs = spark.createDataFrame([("REQ-1", "token expiry"), ("REQ-2", "token rotation"), ("impl.tokens", None)], "id string, title string")
    ids_of = lambda q, k=20: [r.id for r in search.search(docs, ["id", "title"], q, k).collect()]
    assert set(ids_of("token")) == {"REQ-1", "REQ-2"}
    assert ids_of("token expiry") == ["REQ-1"]
    assert ids_of("REQ-1") == ["REQ-1"]
    assert ids_of("okens") == ["impl.tokens"]
    assert ids_of("  ") == [] and ids_of("token", 0) == []


def test_latest_outcome_orders_as_text(spark):
    runs = spark.createDataFrame([("run-1", None), ("a", "2024-05-01")], "run_id string, started_at string")
    results = spark.createDataFrame([("run-1", "t", "fail"), ("a", "t", "pass")], "run_id string, fid string, outcome string")
    assert evidence.latest_outcomes(results, runs).first().outcome == "fail"
    assert {r.run_id: r.status for r in evidence.run_status(results, spark.createDataFrame([("run-1", "pass")], "run_id string, status string")).collect()} == {"run-1": "pass", "a": "pass"}


def test_staleness_is_one_hop(spark):
    n = nodes(spark, ("a", "x", "", 0, 0, "current", True), ("b", "x", "", 0, 0, "stale_review_required", True), ("c", "x", "", 0, 0, "current", True))
    got = change.staleness(n, edges(spark, ("a", "satisfies", "b"), ("c", "satisfies", "a")), spark.createDataFrame([("b",)], "trace_id string"))
    assert {r.trace_id: (r.status, r.changed) for r in got.collect()} == {"a": ("stale_review_required", False), "b": ("current", True), "c": ("current", False)}


def test_incremental_equals_full(spark):
    old = spark.createDataFrame([("a", "x", True), ("b", "x", True), ("c", "y", True)], "trace_id string, path string, active boolean")
    new = spark.createDataFrame([("a", "x", True), ("d", "x", True)], "trace_id string, path string, active boolean")
    got = change.merged_index(old, new, spark.createDataFrame([("x",)], "path string"))
    assert sorted(map(tuple, got.collect())) == [("a", "x", True), ("b", "x", False), ("c", "y", True), ("d", "x", True)]
    assert {r.trace_id for r in change.inactive_except(old, new).filter("active").collect()} == {"a"}


def test_diff_lines_and_ranges(spark):
    diff = "@@ -1,2 +1,3 @@\n a\n+b\n-c\n+d\n@@ -9 +10,0 @@\n-x\n@@ -20,0 +30 @@\n+y"
    rows = spark.createDataFrame([("p", n, x) for n, x in enumerate(diff.split("\n"))], "path string, n int, text string")
    assert sorted((r.line, r.text) for r in structure.added_lines(rows).collect()) == [(2, "b"), (3, "d"), (30, "y")]
    assert sorted((r.s, r.e) for r in readers.diff_ranges(spark.createDataFrame([("p", diff)], "path string, text string")).collect()) == [(1, 3), (30, 30)]


def test_boundary_changes(spark):
    cols = "path string, name string, kind string, fingerprint string"
    got = structure.boundary_changes(spark.createDataFrame([("p", "f", "function", "2"), ("p", "H", "heading", "2"), ("p", "n", "function", "1")], cols), spark.createDataFrame([("p", "f", "function", "1"), ("p", "H", "heading", "1")], cols))
    assert {r.name: r.state for r in got.collect()} == {"f": "modified", "H": "unchanged", "n": "new"}


@pytest.mark.parametrize(("glob", "path", "fits"), [("**/x.py", "x.py", True), ("**/x.py", "a/b/x.py", True), ("src/*.py", "src/a/b.py", False), ("src/**", "src/a/b.py", True), ("[!a]?.md", "b1.md", True), ("[!a]?.md", "a1.md", False)])
def test_path_globs(spark, glob, path, fits):
    assert spark.createDataFrame([(path,)], "p string").select(text.any_glob(F.col("p"), [glob])).first()[0] is fits


def test_uids_count_nulls_as_empty(spark):
    got = spark.range(1).select(ids.edge_uid(F.lit("a"), F.lit("p"), F.lit("b"), F.lit("declared"), F.lit(None), F.lit(None))).first()[0]
    assert got == "e_" + hashlib.sha256(b"a|p|b|declared||").hexdigest()[:32]


def test_fresh_ids(spark):
    got = ids.fresh_ids(spark.createDataFrame([("REQ-a", 0), ("REQ-a", 1), ("REQ-b", 2)], "base string, pos int"), spark.createDataFrame([("REQ-a",)], "trace_id string"))
    assert {r.pos: r.trace_id for r in got.collect()} == {0: "REQ-a-2", 1: "REQ-a-3", 2: "REQ-b"}


KEYS = st.sampled_from(["id", "title", "satisfies", "work", "depends_on"])
VALUES = st.text(st.characters(min_codepoint=32, max_codepoint=126), min_size=1, max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(KEYS, VALUES, min_size=1))
def test_marker_round_trip(pairs):
    line = extract.rendered(list(pairs.items()))
    got, problem = extract.fields(line.removeprefix(text.MARKER))
    assert problem is None and {k: v for k, v, _ in got} == pairs


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_junk_never_raises(junk):
    extract.parse(junk)


def test_marker_grammar(spark):
    lines = ["# trace:v1 id=REQ-1 work=WORK-1", "<!-- trace:v1 id=doc.a title=\"x y\" documents=impl.a,impl.b -->", "text trace:v1 id=no", "/* trace:v1 id=impl.c */", "# trace:v12 id=no"]
    files = spark.createDataFrame([("f", "\r\n".join(lines))], "path string, text string")
    got = extract.marker_lines(files)
    assert [(r.line, r.payload) for r in got.orderBy("line").collect()] == [(1, "id=REQ-1 work=WORK-1"), (2, 'id=doc.a title="x y" documents=impl.a,impl.b'), (4, "id=impl.c")]
    assert sorted((r.f, r.p, r.t) for r in extract.declared_edges(got).collect()) == [("REQ-1", "work", "WORK-1"), ("doc.a", "documents", "impl.a"), ("doc.a", "documents", "impl.b")]
    bad = extract.parse('id=a id=b calls=c foo=1 type=zz satisfies=b@d "')
    assert sorted(r for r, _ in bad["problems"]) == ["TL004", "TL005", "TL006", "TL007", "TL040", "TL040"]


def test_symbols_and_sections(spark):
    py = "@deco\ndef f():\n    pass\n\nclass A:\n    def m(self):\n        return 1\n"
    assert [(k, n, a, b) for k, n, a, b, _ in extract.python_symbols(py)] == [("function", "f", 1, 3), ("class", "A", 5, 7), ("method", "A.m", 6, 7)]
    md = "# A\n```\n# no\n```\n## B\ntext\n# C\n"
    assert extract.markdown_headings(md) == [(1, 1, 6, "A"), (2, 5, 6, "B"), (1, 7, 7, "C")]
    assert extract.yaml_sections("a:\n  b: 1\nc: 2\n") == [("a", 1, 2), ("a.b", 2, 2), ("c", 3, 3)] and extract.yaml_sections("a: [") == []
    assert [(k, n, a, b) for k, n, a, b, _ in declarations("func (t T) Do() {\n  x\n}\ntype T struct {\n}\n", "go")] == [("method", "T.Do", 1, 3), ("struct", "T", 4, 5)]
    files = spark.createDataFrame([("a.py", "python", py), ("b.md", "markdown", md), ("c.bin", None, None)], "path string, language string, text string")
    assert extract.symbols(files).groupBy("parser").count().count() == 2


def test_reports_from_files(spark, tmp_path):
    (tmp_path / "j.xml").write_text('<testsuites><testsuite><testcase classname="m" name="a" time="0.5"/><testcase name="b" time="x"><failure message="no"/></testcase><testcase classname="m" name="c"><skipped/></testcase></testsuite></testsuites>')
    got = {r.framework_test_id: (r.outcome, r.duration_ms) for r in readers.read_junit(spark, f"{tmp_path}/j.xml").collect()}
    assert got == {"m.a": ("pass", 500.0), "b": ("fail", None), "m.c": ("skip", None)}
    (tmp_path / "c.xml").write_text('<coverage><packages><package><classes><class filename="a.py"><methods><method><lines><line number="3" hits="1"/></lines></method></methods><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>')
    assert sorted((r.path, r.line) for r in readers.read_cobertura(spark, f"{tmp_path}/c.xml").collect()) == [("a.py", 1), ("a.py", 3)]
    for name, outcome in (("good", "pass"), ("bad", "odd")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"run_id": name, "status": "pass", "tests": [{"framework_id": "t", "outcome": outcome}]}))
    assert [r.run_id for r in readers.read_evidence(spark, f"{tmp_path}/*.json").collect()] == ["good"]
    (tmp_path / "r.jsonl").write_text('{"work": "W", "path": "b"}\nnot json\n{"work": "W", "path": "a"}\n')
    assert [(r.work, r.paths) for r in readers.work_paths(readers.read_receipts(spark, f"{tmp_path}/r.jsonl")).collect()] == [("W", ["a", "b"])]


def test_scan_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/r.md").write_text("# A\n")
    got = readers.with_scope(readers.scan_files(spark, str(tmp_path), exclude=["docs/private/**"]), {"core": ["src"], "all": ["docs", "src/x"]})
    assert sorted((r.path, r.kind, r.language, r.scope) for r in got.collect()) == [("docs/r.md", "doc", "markdown", "all"), ("src/a.py", "source", "python", "core")]


def test_snapshot(spark, tmp_path):
    readers.write_snapshot({"nodes": spark.range(2)}, str(tmp_path), "v9")
    readers.write_snapshot({"nodes": spark.range(5)}, str(tmp_path), "v10")
    assert readers.read_snapshot(spark, str(tmp_path), "nodes").count() == 5


def test_resolve(spark):
    work = spark.createDataFrame([("WORK-1", "rotate refresh tokens", "active", [("REQ-1", "token rotation")], "auth", False, False), ("WORK-2", "billing", "active", [], None, True, False), ("WORK-3", "rotate logs", "done", [], None, True, True)], "trace_id string, title string, status string, reqs array<struct<id: string, title: string>>, boundary string, changed boolean, recent boolean")
    prompts = spark.createDataFrame([("p", "please rotate the tokens", None), ("q", "something else", None), ("r", "the", None), ("s", "no match", "work-1-branch")], "prompt string, text string, branch string")
    hits = spark.createDataFrame([("s", "REQ-1")], "prompt string, trace_id string")
    got = {r.prompt: (r.work, r.confidence, r.resolution) for r in tasks.resolved(prompts, work, hits).collect()}
    # The second resumes what is being changed right now.
    assert got == {"p": ("WORK-1", 1.0, "resume"), "q": ("WORK-2", 0.7, "resume"), "r": (None, 0.0, "new"), "s": ("WORK-1", 1.0, "resume")}


def test_waivers(spark):
    found = spark.createDataFrame([("TL010", "a", "p", 1, None), ("TL010", "a", "p", 1, None), ("TL020", "b", None, None, None), ("TL061", None, None, None, None)], "rule string, trace_id string, path string, line int, detail string")
    waivers = spark.createDataFrame([("TL010", "a", None, None, "known", None, 1), ("TL010", None, None, "late", None, None, 2), ("TL020", None, "p", "x", None, None, 0), ("TL061", None, None, "x", None, None, 0)], "rule string, trace_id string, path string, owner string, reason string, expires date, pos int")
    rows = [(r.rule, r.severity, r.waiver) for r in policy.waived(found, waivers, "2024-01-01").orderBy("rule").collect()]
    assert rows == [("TL010", "INFO", "known"), ("TL010", "INFO", "known"), ("TL020", "ERROR", None), ("TL061", "ERROR", None)]


def test_work_items_and_sidecars(spark, tmp_path):
    files = spark.createDataFrame([(".trace/work.toml", '[work."WORK-1"]\ntitle = "One"\nmirrors = {jira = "J-1"}\n[work."bad id"]\ntitle = 3\n'), ("x.toml", "= no")], "path string, text string")
    got = {(r.path, r.trace_id): (r.title, r.mirrors, r.problem) for r in readers.work_items(files).collect()}
    assert got[".trace/work.toml", "WORK-1"] == ("One", '{"jira": "J-1"}', None) and got[".trace/work.toml", "bad id"][2] == "invalid id" and got["x.toml", None][2].startswith("not TOML")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "c.json.json").write_text('{"entries": [{"line": 4, "key": "k", "marker": "# trace:v1 id=a"}]}')
    cars = readers.read_sidecars(spark, str(tmp_path))
    assert [tuple(r) for r in cars.collect()] == [("a/c.json", "k", 4, "# trace:v1 id=a")]


def test_blocks(spark):
    text = "# REQ-1 First thing\n<!-- trace:v1 id=REQ-1 derived_from=PRD-1,PRD-1 -->\nbody\n```\n# REQ-9 code\n```\n## Notes\nmore\n# ADR-2: Second\nx\n"
    rows = {r.trace_id: r for r in extract.blocks(spark.createDataFrame([("a.md", text)], "path string, text string")).collect()}
    assert rows.keys() == {"REQ-1", "ADR-2"}
    assert (rows["REQ-1"].node_type, rows["REQ-1"].title, rows["REQ-1"].s, rows["REQ-1"].e, [tuple(e) for e in rows["REQ-1"].edges]) == ("requirement", "First thing", 1, 8, [("derived_from", "PRD-1")])
    assert (rows["ADR-2"].node_type, rows["ADR-2"].title) == ("decision", "Second")


def test_parser_registry(spark):
    extract.register("lines", lambda text: [("line", x, n, n, None, "lines") for n, x in enumerate(text.splitlines(), 1)])
    try:
        rows = extract.symbols(spark.createDataFrame([("a", "lines", "x\ny"), ("b", "none", "z")], "path string, language string, text string"))
        assert sorted((r.name, r.s, r.parser) for r in rows.collect()) == [("x", 1, "lines"), ("y", 2, "lines")]
    finally:
        del extract.PARSERS["lines"]


def test_index_runs(spark):
    def run(texts, **more):
        files = spark.createDataFrame(list(texts.items()), "path string, text string")
        found = extract.symbols(files.withColumn("language", F.lit("python")))
        return index.run(files, found.withColumn("id", F.concat_ws(":", "name", "s")), **more)

    a = "# trace:v1 id=impl.a work=WORK-1 depends_on=impl.b\ndef a():\n    return 1\n"
    b = "class B:\n    # trace:v1 id=impl.b\n    def b(self):\n        return 2\n"
    one = run({"a.py": a, "b.py": b})
    nodes = {r.trace_id: r for r in one.nodes.collect()}
    assert (nodes["impl.a"].attachment, nodes["impl.a"].s, nodes["impl.b"].s, nodes["impl.b"].e, nodes["impl.b"].parser) == ("symbol", 2, 1, 4, "ast")
    assert {(r.f, r.p, r.t) for r in one.edges.collect()} == {("impl.a", "work", "WORK-1"), ("impl.a", "depends_on", "impl.b")}
    assert [(r.rule, r.detail) for r in one.findings.collect()] == [("TL002", "impl.a work -> WORK-1")]
    paths = spark.createDataFrame([("b.py",)], "path string")
    two = run({"a.py": a, "b.py": b.replace("2", "3") + "# trace:v1 id=impl.a\n"}, previous=one, changed_paths=paths, at="1")
    assert {r.trace_id: r.status for r in two.nodes.collect()}["impl.b"] == "current"
    three = run({"b.py": b.replace("2", "4")}, previous=one, changed_paths=paths, at="1")
    state = {r.trace_id: (r.status, r.changed, r.active) for r in three.nodes.collect()}
    assert state == {"impl.a": ("stale_review_required", False, True), "impl.b": ("current", True, True)}
    four = run({"b.py": "x = 1\n"}, previous=three, changed_paths=paths, at="2")
    state = {r.trace_id: (r.status, r.active) for r in four.nodes.collect()}
    assert state == {"impl.a": ("stale_review_required", True), "impl.b": ("current", False)}
    assert four.report(spark.range(2)).first().files == 2


def test_ingest(spark):
    reports_ = spark.createDataFrame([("r1", "pass", "rev", "ci", None, None, [("t.one", "pass", 1.0, None), ("t.two", "fail", 2.0, "test.x")], [("test.one", "impl.a", "per_test", 3)])], "run_id string, status string, revision string, provider string, started_at string, completed_at string, tests array<struct<framework_id: string, outcome: string, duration_ms: double, trace_id: string>>, execution_edges array<struct<test_uid: string, implementation_uid: string, coverage_kind: string, hit_count: bigint>>")
    tests = spark.createDataFrame([("test.one", "t.one")], "trace_id string, framework_test_id string")
    runs = spark.createDataFrame([("r1", "old", "fail"), ("r0", "old", "pass")], "run_id string, revision string, status string")
    results = spark.createDataFrame([("r1", "t.gone", None, "pass", 0.0)], "run_id string, fid string, test string, outcome string, duration_ms double")
    executions = spark.createDataFrame([("r0", "a", "b", "suite", 1)], "run_id string, test string, impl string, kind string, hits long")
    a, b, c = evidence.ingested(reports_, tests, runs, results, executions)
    assert sorted(map(tuple, a.collect())) == [("r0", "old", "pass"), ("r1", "rev", "pass")]
    assert sorted(map(tuple, b.collect())) == [("r1", "t.one", "test.one", "pass", 1.0), ("r1", "t.two", "test.x", "fail", 2.0)]
    assert c.count() == 2


def test_suggested_markers(spark):
    marked = spark.createDataFrame([("src/a.py", "app.Service.save", "method", "python", 3), ("src/b.py", "app.Service.save", "method", "python", 9), ("tests/test_a.py", "test_it", "function", "python", 1), ("docs/r.md", "REQ-1 Title", "heading", "markdown", 1), ("src/c.ts", "handleHTTPRequest", "function", "typescript", 1)], "path string, name string, kind string, language string, s int")
    taken = spark.createDataFrame([("test.test-it",)], "trace_id string")
    got = {(r.path, r.role): r.marker for r in boundaries.suggested(marked, taken, work="WORK-1", requirement="REQ-2").collect()}
    assert got == {
        ("src/a.py", "impl"): "# trace:v1 id=impl.app-service.save work=WORK-1 satisfies=REQ-2", ("src/b.py", "impl"): "# trace:v1 id=impl.app-service.save-2 work=WORK-1 satisfies=REQ-2",
        ("tests/test_a.py", "test"): "# trace:v1 id=test.test-it-2 work=WORK-1 verifies=REQ-2", ("docs/r.md", "requirement"): "<!-- trace:v1 id=requirement.req-1-title work=WORK-1 -->",
        ("src/c.ts", "impl"): "// trace:v1 id=impl.handlehttp-request work=WORK-1 satisfies=REQ-2",
    }


def test_bundle_faults():
    sound = {"title": "T", "kind": "new feature", "requirements": [{"title": "R"}]}
    assert tasks.faults(json.dumps(sound)) == [] and tasks.faults("[]") == tasks.faults("{") == tasks.faults(None) == ["bundle: no JSON object"]
    assert tasks.faults(json.dumps(sound | {"requirements": []})) == ["requirements: none for new behaviour"] and tasks.faults(json.dumps(sound | {"kind": "refactor", "requirements": None})) == []
    assert tasks.faults(json.dumps({"kind": 3, "requirements": [1, {"title": "a"}, {"title": " a"}], "plan": [], "intent": 2})) == ["title: missing", "kind: unknown", "requirements[0]: no object", "requirements[2].title: repeated", "plan: no object", "intent: no text"]


def test_session(spark, tmp_path):
    nodes = spark.createDataFrame([("impl.a", "implementation", "a.py", 1, 3, "current", True), ("WORK-1", "work", "w", None, None, "current", True)], "trace_id string, node_type string, path string, s int, e int, status string, active boolean")
    edges = spark.createDataFrame([("impl.a", "work", "WORK-1", "active")], "f string, p string, t string, status string")
    session.Traceability(nodes, edges).write(str(tmp_path), "1")
    own = session.Traceability.read(spark, str(tmp_path))
    assert [r.chain for r in own.why("impl.a").collect()] == ["WORK-1-impl.a"] and [r.trace_id for r in own.impact("WORK-1").collect()] == ["impl.a"]
    assert own.verify("standard").count() == 0 and own.context("impl.a").count() == 1 and [r.id for r in own.search("impl").collect()] == ["impl.a"]


def test_indexed_search_equals_the_scan(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "b c d"), (3, "a d")], "id int, text string")
    terms, lengths = search.postings(docs, ["text"])
    scan = [(r.id, round(r.score, 9)) for r in search.bm25(docs, ["text"], "b c").collect()]
    assert scan == [(r.id, round(r.score, 9)) for r in search.bm25_indexed(terms, lengths, "b c").collect()] and len(scan) == 2


def test_audit_package(spark):
    nodes = spark.createDataFrame([("impl.a", "implementation", "a.py"), ("impl.z", "implementation", "z.py"), ("REQ-1", "requirement", "r.md"), ("test.a", "test", "t.py")], "trace_id string, node_type string, path string").withColumn("active", F.lit(True))
    edges = spark.createDataFrame([("impl.z", "work", "WORK-1"), ("impl.z", "satisfies", "REQ-1"), ("test.a", "exercises", "impl.z")], "f string, p string, t string")
    found = spark.createDataFrame([("TL010", "impl.a", "a.py", "x")], "rule string, trace_id string, path string, detail string")
    changed = spark.createDataFrame([("new.py",), ("a.py",)], "path string")
    outcomes = spark.createDataFrame([("test.a", "fail")], "fid string, outcome string")
    rows = reports.audit_package("WORK-1", nodes, edges, changed, found, outcomes).orderBy("section", "rank").collect()
    assert [(r.section, r.trace_id, r.detail) for r in rows] == [("findings", "impl.a", "TL010 a.py x"), ("implementations", "impl.z", "WORK-1 > REQ-1 > impl.z > test.a"), ("implementations", "impl.a", "impl.a"), ("requirements", "REQ-1", None), ("tests", "test.a", "fail"), ("unexpected", "new.py", None)]


def test_audit_bundle(spark):
    nodes = spark.createDataFrame([("impl.a", "implementation", "a.py", 2, 3, "stale_review_required", "alpha"), ("impl.z", "implementation", "z.py", 0, 900, "current", "omega"), ("REQ-1", "requirement", "r.md", None, None, "current", None), ("test.a", "test", "t.py", 1, 1, "current", None), ("test.b", "test", "t.py", 2, 2, "current", None), ("PLAN-1", "plan", "p.md", 1, 1, "current", None)], "trace_id string, node_type string, path string, s int, e int, status string, symbol string").withColumn("active", F.lit(True))
    edges = spark.createDataFrame([("impl.z", "work", "WORK-1", "active"), ("impl.z", "satisfies", "REQ-1", "active"), ("test.a", "exercises", "impl.z", "active"), ("test.b", "exercises", "impl.z", "active"), ("impl.a", "implements", "PLAN-1", "active"), ("impl.z", "implements", "PLAN-1", "superseded")], "f string, p string, t string, status string")
    texts = spark.createDataFrame([("a.py", "one\n  two\nthree \nfour"), ("z.py", "\n".join(f"line {k}" for k in range(900))), ("t.py", "calls omega\ncalls nothing"), ("r.md", "# R\n")], "path string, text string")
    expects = spark.createDataFrame([("PLAN-1", "impl.a"), ("PLAN-1", "impl.z"), ("PLAN-1", "impl.gone")], "plan string, expected string")
    found = spark.createDataFrame([("TL010", "impl.a", "a.py", "x")], "rule string, trace_id string, path string, detail string")
    outcomes = spark.createDataFrame([("test.a", "pass")], "fid string, outcome string")
    bundle = reports.audit_bundle("WORK-1", nodes, edges, texts, spark.createDataFrame([("new.py",)], "path string"), found, outcomes, expects, symbol=F.col("symbol"), most_lines=3)
    rows = {(r.section, r.rank): (r.trace_id, r.detail, r.excerpt) for r in bundle.collect()}
    assert rows == {
        ("implementations", 1): ("impl.z", "WORK-1 > REQ-1 > impl.z > test.a > test.b", "line 0\nline 1\nline 2"), ("implementations", 2): ("impl.a", "impl.a", "two\nthree"), ("requirements", 1): ("REQ-1", None, "# R"),
        ("tests", 1): ("test.a", "pass", "calls omega"), ("tests", 2): ("test.b", None, "calls nothing"), ("findings", 1): ("impl.a", "TL010 a.py x", None), ("unexpected", 1): ("new.py", None, None),
        ("suspects", 1): ("test.b", "misleading_test impl.z", None), ("suspects", 2): ("impl.a", "drift", None), ("suspects", 3): ("PLAN-1", "plan_gap impl.gone", None), ("suspects", 4): ("PLAN-1", "plan_gap impl.z", None),
    }
    made = json.loads(reports.bundle_json(bundle, "WORK-1").first().json)
    assert made["status"] == "fail" and [x["id"] for x in made["sections"]["tests"]] == ["test.a", "test.b"] and made["sections"]["implementations"][1]["excerpt"] == "two\nthree"


def test_doctor_tells_stored_findings_and_renames(spark):
    nodes = spark.createDataFrame([("impl.a", "new.py", "current", True), ("impl.b", "old.py", "stale_review_required", True), ("impl.c", "new.py", "current", True)], "trace_id string, path string, status string, active boolean")
    edges = spark.createDataFrame([("impl.a", "work", "impl.b")], "f string, p string, t string")
    stored = spark.createDataFrame([("TL003", "impl.a", "new.py", 3, "file"), ("TL040", None, "x.md", 1, "unknown k"), ("TL020", "REQ-1", "r.md", 1, None)], "rule string, trace_id string, path string, line int, detail string")
    commits = spark.createDataFrame([("new.py", "old.py")], "path string, old_path string")
    rows = doctor.ordered(doctor.examined(nodes, edges, spark.createDataFrame([], "trace_id string, path string, line int"), stored=stored, commits=commits)).collect()
    assert [(r.rule, r.severity, r.trace_id, r.path, r.line, r.detail) for r in rows] == [
        ("TL003", "WARNING", "impl.a", "new.py", 3, "file"), ("TL005", "INFO", "impl.b", "new.py", None, "renamed from old.py; candidate impl.a"), ("TL005", "INFO", "impl.b", "new.py", None, "renamed from old.py; candidate impl.c"),
        ("TL040", "ERROR", None, "x.md", 1, "unknown k"), ("TL110", "INFO", "impl.b", "old.py", None, "review"),
    ]


def test_ranges_unite_and_last_classes_count(spark, tmp_path):
    diff = "@@ -1 +1,3 @@\n@@ -5 +4,2 @@\n@@ -9 +20,0 @@\n@@ -30 +30 @@"
    assert sorted((r.s, r.e) for r in readers.diff_ranges(spark.createDataFrame([("p", diff)], "path string, text string")).collect()) == [(1, 5), (30, 30)]
    line = lambda n: f'<line number="{n}" hits="1"/>'
    (tmp_path / "c.xml").write_text(f'<coverage><packages><package><classes><class filename="a.py"><lines>{line(1)}{line(2)}</lines></class><class filename="b.py"><lines>{line(7)}</lines></class><class filename="a.py"><lines>{line(3)}</lines></class></classes></package></packages></coverage>')
    assert sorted((r.path, r.line) for r in readers.read_cobertura(spark, f"{tmp_path}/c.xml").collect()) == [("a.py", 3), ("b.py", 7)]


def test_ignored_paths_are_not_scanned(spark, tmp_path):
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text("x = 1\n")
    ignored = spark.createDataFrame([("b.py",)], "path string")
    assert [r.path for r in readers.scan_files(spark, str(tmp_path), ignored=ignored).collect()] == ["a.py"]


def test_an_audit_table_counts_with_one_known_result(spark, ctx):
    table = lambda *x: spark.createDataFrame([(v,) for v in x], "schema string")
    ctx.audit = table("other", None)
    assert rules.audit_missing(ctx).count() == 1
    ctx.audit = table("other", "x/audit-result/v1")
    assert rules.audit_missing(ctx).count() == 0

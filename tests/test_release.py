"""The rules at release: what goes through the driver, and waivers of every shape."""

import itertools

from pyspark.sql import functions as F

from linkgrain import queries
from linkgrain.operators import rules
from linkgrain.plans import policy


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_send_no_graph_through_the_driver(spark, small):
    """Packed, ids are under any limit of size: here each of these tables would be broadcast."""
    b = queries.Bridge(spark, small).stored("nodes", "edges")
    ctx = queries.context(b, revision="rev1", per_test=True, lifecycle="release")
    for rule in ("TL002", "TL010", "TL011", "TL014", "TL020", "TL022", "TL030"):
        made = plan(rules.REGISTRY[rule](ctx))
        assert "SortMergeJoin" in made and "BroadcastHashJoin" not in made, rule
    assert "BroadcastHashJoin" not in plan(b.links)


def test_release_findings_are_stored_rule_by_rule(spark, small, monkeypatch):
    made = []
    monkeypatch.setattr(policy, "kept", lambda df, name, kept=policy.kept: made.append(name) or kept(df, name))
    b = queries.Bridge(spark, small)
    found = queries.release_findings(b, "TL014", "TL020", "TL061")
    assert made == ["findings-TL014", "findings-TL020", "findings-TL061"]
    assert {r.rule for r in found.select("rule").distinct().collect()} == set(queries.release_findings(queries.Bridge(spark, small)).filter("rule in ('TL014', 'TL020', 'TL061')").toPandas()["rule"])


def test_waivers_of_every_shape(spark):
    some = [None, "a", "b"]
    found = [(rule, i, p) for rule in ("TL010", "TL020", "TL061") for i in some for p in some]
    waivers = [("TL010", None, None, "all", 9), ("TL010", "a", None, "id", 2), ("TL010", None, "b", "path", 1), ("TL010", "b", "a", "both", 3), ("TL020", "b", "b", "one", 0), ("TL061", None, None, "never", 0)]
    w = spark.createDataFrame(waivers, "rule string, trace_id string, path string, owner string, pos int").withColumn("expires", F.lit(None).cast("date"))
    rows = spark.createDataFrame(found, "rule string, trace_id string, path string").withColumns({"line": F.lit(1), "detail": F.lit("")})
    got = {(r.rule, r.trace_id, r.path): r.waiver for r in policy.waived(rows, w, "2024-01-01").collect()}
    fits = lambda f, x: f[0] == x[0] != "TL061" and x[1] in (None, f[1]) and x[2] in (None, f[2])
    assert got == {f: min(((x[4], x[3]) for x in waivers if fits(f, x)), default=(0, None))[1] for f in itertools.chain(found)}

"""Requests against work items of the same words."""

from pyspark.sql import functions as F

from linkgrain.operators import tasks


def test_work_items_of_the_same_words_meet_once(spark, monkeypatch):
    n = F.col("id")
    work = spark.range(600).select(
        F.concat(F.lit("WORK-S"), n).alias("trace_id"), F.concat(F.lit("bill export "), n % 2).alias("title"), F.when(n % 5 == 0, "active").when(n % 7 == 1, "done").alias("status"), F.array(F.struct(F.concat(F.lit("REQ-"), n).alias("id"), F.lit("totals").alias("title"))).alias("reqs"),
        F.when(n % 3 == 0, "ledger").alias("boundary"), (n % 11 == 4).alias("changed"), (n % 13 == 2).alias("recent"),
    )
    prompts = spark.createDataFrame([("a", "export bill", None), ("b", "ledger 1", "s33"), ("c", "totals", "s7 work s8"), ("d", "none", "fix s12"), ("e", "bill", None), ("f", "bill 0", "bill")], "prompt string, text string, branch string")
    hits = spark.createDataFrame([("e", "WORK-S22"), ("e", "REQ-301"), ("d", "WORK-S1")], "prompt string, trace_id string")
    made = {}
    monkeypatch.setattr(tasks, "kept", lambda df, name, kept=tasks.kept: made.setdefault(name, kept(df, name)), raising=False)
    got = {r.prompt: (r.work, r.confidence, r.sources) for r in tasks.resolved(prompts, work, hits).collect()}
    plan = tasks.resolved(prompts, work, hits)._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.split("\n") if "SortMergeJoin [trace_id" in x]
    assert made["words"].select("trace_id").distinct().count() == 4

    items = [r.asDict() for r in work.collect() if r.status != "done"]
    found = hits.collect()
    for p in prompts.collect():
        want, on = p.text.split(), [x for x in (p.branch or "").split() if x not in ("work", "fix")]
        scored = []
        for w in items:
            title, own = w["title"].split(), {h.trace_id for h in found if h.prompt == p.prompt} & {w["trace_id"], w["reqs"][0]["id"]}
            names = [*title, w["trace_id"][5:].lower()]
            score = 2.0 * len(set(want) & set(title)) / len(want) + 0.5 * len(set(want) & {w["boundary"]}) / len(want) + 1.5 * ("totals" in want) + 0.6 * bool(own) + 0.4 * bool(set(on) & set(names)) + 0.4 * w["changed"] + 0.3 * w["recent"] + 0.3 * (w["status"] == "active")
            scored.append((-round(score, 9), w["trace_id"]))
        best, id_ = min(scored)
        sure = min(1.0, -best)
        assert got[p.prompt][:2] == (id_ if sure >= tasks.RESUME else None, round(sure, 2)), p

"""Tasks: bundles from requests, their faults, activation, obligations, and which task a request resumes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import slug
from ..scratch import kept
from .reports import request_tokens
from .rules import live

# Kinds of tasks; the first five bring new behaviour and need a requirement.
BEHAVIORAL = ("GREENFIELD_PROJECT", "NEW_FEATURE", "FEATURE_EXTENSION", "BEHAVIOR_CHANGE", "BUG_CONTRACT_BACKFILL")
KINDS = (*BEHAVIORAL, "REFACTOR", "MAINTENANCE", "NON_BEHAVIORAL_EDIT")
RESUME = 0.55


def _cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def bundle(prompt: Column) -> Column:
    """A struct of title, kind, intent, requirements and plan from a request's words."""
    text = F.trim(F.regexp_replace(prompt, r"\s+", " "))
    title = F.when(text == "", "Task").otherwise(_cut(text, 72))
    requirement = F.struct(F.concat(F.lit("Implement "), _cut(title, 60)).alias("title"), text.alias("statement"))
    steps = F.array(F.concat(F.lit("Implement: "), _cut(text, 200)))
    return F.struct(title.alias("title"), F.lit("new_feature").alias("kind"), text.alias("intent"), F.array(requirement).alias("requirements"), F.struct(F.lit(True).alias("recommended"), steps.alias("steps")).alias("plan"))


def named_ids(prompt: Column) -> Column:
    """Ids of work, requirements and plans that a request names, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(prompt, F.lit(r"\b(?:WORK|REQ|PLAN)-[A-Za-z0-9._\-]*[A-Za-z0-9]"), 0))


def faults(text: str | None) -> list[str]:
    """What is wrong with one bundle as JSON."""
    try:
        made = json.loads(text or "")
    except ValueError:
        made = None
    if not isinstance(made, dict):
        return ["bundle: no JSON object"]
    words = lambda x: isinstance(x, str) and bool(x.strip())
    strings = lambda x: isinstance(x, list) and all(isinstance(y, str) for y in x)
    out = [] if words(made.get("title")) else ["title: missing"]
    kind = made["kind"].strip().upper().replace("-", "_").replace(" ", "_") if words(made.get("kind")) else None
    if kind not in KINDS:
        kind = None
        out.append("kind: unknown")
    reqs = made.get("requirements") or []
    if not isinstance(reqs, list):
        out.append("requirements: no list")
        reqs = []
    seen = set()
    for n, r in enumerate(reqs):
        if not isinstance(r, dict):
            out.append(f"requirements[{n}]: no object")
            continue
        title = r.get("title")
        if not words(title):
            out.append(f"requirements[{n}].title: missing")
        elif title.strip() in seen:
            out.append(f"requirements[{n}].title: repeated")
        else:
            seen.add(title.strip())
        if not isinstance(r.get("statement", ""), str | None):
            out.append(f"requirements[{n}].statement: no text")
        if r.get("acceptance") is not None and not strings(r["acceptance"]):
            out.append(f"requirements[{n}].acceptance: no list of texts")
    if kind in BEHAVIORAL and not reqs:
        out.append("requirements: none for new behaviour")
    plan = made.get("plan")
    if plan is not None and not isinstance(plan, dict):
        out.append("plan: no object")
    elif plan and plan.get("steps") is not None and not strings(plan["steps"]):
        out.append("plan.steps: no list of texts")
    if made.get("intent") is not None and not isinstance(made["intent"], str):
        out.append("intent: no text")
    return out


def with_faults(bundles: DataFrame, column: str = "bundle") -> DataFrame:
    """``bundles`` with ``faults`` of the JSON in a column, an empty array for a sound one."""

    def check(texts: pd.Series) -> pd.Series:
        return pd.Series([faults(x) for x in texts])

    return bundles.withColumn("faults", F.pandas_udf(check, "array<string>")(F.col(column)))


def activation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(work, requirements, plan) of active work items.

    Requirements are tied to the work item itself or satisfied by its
    implementations; the plan is the first, by edge, that is tied to it or that
    one of its implementations implements.
    """
    kinds = nodes.select(F.col("trace_id").alias("f"), "node_type")
    own = edges.filter("p = 'work'").select("f", F.col("t").alias("work")).join(kinds, "f")
    impl = own.filter("node_type = 'implementation'").select("f", "work").join(edges.filter(F.col("p").isin("satisfies", "implements")).select("f", "p", "t"), "f")
    reqs = own.filter("node_type = 'requirement'").select("work", F.col("f").alias("req")).unionByName(impl.filter("p = 'satisfies'").select("work", F.col("t").alias("req")))
    plans = own.filter("node_type = 'plan'").select("work", F.struct("f", F.lit("").alias("t")).alias("edge"), F.col("f").alias("plan")).unionByName(impl.filter("p = 'implements'").select("work", F.struct("f", "t").alias("edge"), F.col("t").alias("plan")))
    work = nodes.filter("active and node_type = 'work'").select(F.col("trace_id").alias("work"))
    reqs = reqs.groupBy("work").agg(F.array_sort(F.collect_set("req")).alias("requirements"))
    plans = plans.groupBy("work").agg(F.min_by("plan", "edge").alias("plan"))
    return work.join(reqs, "work", "left").join(plans, "work", "left").select("work", F.coalesce("requirements", F.expr("cast(array() as array<string>)")).alias("requirements"), "plan")


def reconciled(pending: DataFrame, current: DataFrame, ids: DataFrame) -> DataFrame:
    """``pending`` (path, symbol, suggested) with ``state`` against the present tree.

    ``current``: path, name, traced, a row for each boundary; ``ids``: path and
    trace_id of the markers in it.  An obligation is met if its boundary, by name
    or else by slug, is traced.  If the boundary is gone the obligation is stale,
    unless the file has the suggested id, which tells of a rename.
    """
    last = lambda c: slug(F.element_at(F.split(c, r"\."), -1))
    there = current.select("path", "name", "traced", last(F.col("name")).alias("slug"))
    asked = pending.select("path", "symbol", "suggested", last(F.col("symbol")).alias("slug"))
    by_name = there.groupBy("path", F.col("name").alias("symbol")).agg(F.bool_or("traced").alias("named"))
    by_slug = there.groupBy("path", "slug").agg(F.bool_or("traced").alias("alike"))
    has = ids.select("path", F.col("trace_id").alias("suggested"), F.lit(True).alias("kept")).distinct()
    rows = asked.join(by_name, ["path", "symbol"], "left").join(by_slug, ["path", "slug"], "left").join(has, ["path", "suggested"], "left")
    traced = F.coalesce("named", "alike")
    state = F.when(traced, "satisfied").when(traced.isNotNull(), "pending").when(F.col("kept"), "pending").otherwise("stale")
    return rows.select("path", "symbol", "suggested", state.alias("state"))


def drifted(requirements: DataFrame, blocks: DataFrame) -> DataFrame:
    """(trace_id, drifted): requirements (trace_id, path, title, fingerprint) whose block (trace_id, path, title, fingerprint) in the present text is gone or differs.

    Without a recorded fingerprint only a missing block tells of a change; a
    requirement without a path never drifts.
    """
    now = blocks.select("trace_id", "path", F.col("title").alias("t"), F.col("fingerprint").alias("f"), F.lit(True).alias("there"))
    rows = requirements.join(now, ["trace_id", "path"], "left")
    other = ~F.col("f").eqNullSafe(F.col("fingerprint")) | ~F.col("t").eqNullSafe(F.col("title"))
    return rows.select("trace_id", F.when(F.col("path").isNull(), False).when(F.col("there").isNull(), True).when(F.col("fingerprint").isNull(), False).otherwise(other).alias("drifted"))


def owners(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Work items of the active nodes at the paths: measured paths meet those of nodes, by their work edges."""
    own = nodes.filter("active").join(paths.select("path").distinct(), "path", "left_semi").select(F.col("trace_id").alias("f"))
    return live(edges).filter("p = 'work'").join(own, "f", "left_semi").select(F.col("t").alias("work")).distinct()


def resolved(prompts: DataFrame, work: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """The task that each request resumes: prompt, work, confidence, resolution (``resume`` or ``new``), requirements, sources.

    ``prompts``: prompt, text, branch, and ``active``, the work of the request's
    session, where there are sessions.  An active one is resumed for sure where
    the request shares a word with its title or those of its requirements, says
    ``keep`` or ``again``, or points with ``this``, ``that`` or ``it``.  ``work``: trace_id, title, status, reqs
    (array of id and title), boundary (names at the paths that it changed),
    changed and recent (whether it owns paths of the present change or of the
    last commits).  ``hits``: prompt and trace_id of a text search.  Words of the
    title weigh 2, requirement titles 1.5 between them, a search hit 0.6, a word
    of the branch 0.4, boundary words 0.5, a present change 0.4, a recent one
    0.3, open work 0.3; done work is out.  The best work item counts, ties to the
    smaller id.

    A request meets work items that share a word, a hit or a branch word, and the
    one that is best without any: no other can win.  Of work items with the same
    words only one can win by them, that of the largest base and then the
    smallest id, so pairs grow with the different words, not with the work items;
    likewise of those whose ids share a word with the branch.
    """
    active = F.col("active") if "active" in prompts.columns else F.lit(None).cast("string")
    low = F.lower("text")
    points = low.rlike(r"\b(?:this|that|it)\b") & ~low.rlike(r"\b(?:its|itself|this_|that_)\b")
    p = prompts.select("prompt", request_tokens(F.col("text")).alias("want"), request_tokens(F.coalesce("branch", F.lit(""))).alias("on"), active.alias("active"), (points & (F.trim("text") != "")).alias("points"))
    asked = p.filter(F.size("want") > 0)
    title = F.coalesce("title", "trace_id")
    base = F.when(F.col("changed"), 0.4).otherwise(0.0) + F.when(F.col("recent"), 0.3).otherwise(0.0) + F.when(F.col("status") == "active", 0.3).otherwise(0.0)
    w = work.filter("coalesce(status, '') <> 'done'").select(
        "trace_id", request_tokens(title).alias("title"), F.array_union(request_tokens(title), request_tokens(F.col("trace_id"))).alias("names"), request_tokens(F.coalesce("boundary", F.lit(""))).alias("boundary"),
        F.transform("reqs", lambda r: request_tokens(F.coalesce(r["title"], r["id"]))).alias("reqs"), F.array_append(F.transform("reqs", lambda r: r["id"]), F.col("trace_id")).alias("ids"), base.alias("base"), "changed", "recent", (F.coalesce("status", F.lit("")) == "active").alias("open"),
    )
    same = ["title", "boundary", "reqs"]
    first = F.min_by("trace_id", F.struct(-F.col("base"), F.col("trace_id"))).alias("trace_id")
    # Written, so that their size is known: where they are few, they go to the requests.
    of_words = kept(w.groupBy(*same).agg(first).select("trace_id", F.explode(F.array_distinct(F.concat("title", "boundary", F.flatten("reqs")))).alias("word")), "words")
    named = w.select("trace_id", "base", *same, F.explode("names").alias("word"))
    asked_on = kept(asked.select(F.explode("on").alias("word")).distinct(), "branch-words")
    of_names = kept(named.join(asked_on, "word", "left_semi").groupBy("word", *same).agg(first).select("trace_id", "word"), "names")
    pairs = asked.select("prompt", F.explode("want").alias("word")).join(of_words, "word").select("prompt", "trace_id")
    pairs = pairs.unionByName(asked.select("prompt", F.explode("on").alias("word")).join(of_names, "word").select("prompt", "trace_id"))
    found = None
    if hits is not None:
        by_id = w.select("trace_id", F.explode("ids").alias("hit"))
        found = kept(hits.select("prompt", F.col("trace_id").alias("hit")).join(by_id, "hit").select("prompt", "trace_id").distinct(), "found")
        pairs = pairs.unionByName(found)
    # Very many requests may meet one work item: what they meet goes to them where it is small, and the quiet one always.
    met = of_words.select("trace_id").unionByName(of_names.select("trace_id"))
    met = kept(w.join((met if found is None else met.unionByName(found.select("trace_id"))).distinct(), "trace_id", "left_semi"), "met")
    quiet = w.orderBy(F.col("base").desc(), "trace_id").limit(1)
    rows = pairs.distinct().join(asked, "prompt").join(met, "trace_id").unionByName(asked.crossJoin(F.broadcast(quiet)))  # one row
    rows = rows.join(found.withColumn("hit", F.lit(0.6)), ["prompt", "trace_id"], "left") if found is not None else rows.withColumn("hit", F.lit(0.0))
    n = F.size("want")
    score = 2.0 * F.size(F.array_intersect("want", "title")) / n + 0.5 * F.size(F.array_intersect("want", "boundary")) / n
    score = score + F.when(F.size("reqs") > 0, 1.5 * F.size(F.filter("reqs", lambda r: F.arrays_overlap("want", r))) / F.greatest(F.size("reqs"), F.lit(1))).otherwise(0.0)
    score = score + F.coalesce("hit", F.lit(0.0)) + F.when(F.arrays_overlap("on", "names"), 0.4).otherwise(0.0) + F.col("base")
    named = [
        ("work_title", F.arrays_overlap("want", "title")), ("requirement_title", F.exists("reqs", lambda r: F.arrays_overlap("want", r))), ("fts", F.coalesce("hit", F.lit(0.0)) > 0), ("branch", F.arrays_overlap("on", "names")),
        ("receipts", F.arrays_overlap("want", "boundary")), ("changed_boundaries", F.col("changed")), ("git_history", F.col("recent")), ("open_work", F.col("open")),
    ]
    sources = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in named]), lambda x: x.isNotNull())
    best = rows.withColumn("score", F.round(score, 9)).withColumn("sources", sources).filter("score > 0").withColumn("n", F.row_number().over(Window.partitionBy("prompt").orderBy(F.col("score").desc(), "trace_id"))).filter("n = 1")
    sure = F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))
    out = p.join(best.select("prompt", "trace_id", "score", "sources", F.col("ids").alias("best_ids")), "prompt", "left")
    # What a session works on is asked by its own words, done or not.
    own = work.select(F.col("trace_id").alias("active"), F.array_union(request_tokens(title), F.flatten(F.transform("reqs", lambda r: request_tokens(F.coalesce(r["title"], r["id"]))))).alias("active_words"), F.transform("reqs", lambda r: r["id"]).alias("active_reqs"))
    out = out.join(own, "active", "left")
    on = F.col("active").isNotNull() & (F.coalesce(F.arrays_overlap("want", "active_words"), F.lit(False)) | F.arrays_overlap("want", F.array(F.lit("keep"), F.lit("again"))) | F.col("points"))
    out = out.withColumn("on_active", F.coalesce(on, F.lit(False)))
    resumes = F.col("on_active") | (sure >= RESUME)
    ids = lambda c: F.array_sort(F.coalesce(c, F.expr("cast(array() as array<string>)")))
    reqs = F.filter("best_ids", lambda x: x != F.col("trace_id"))
    return out.select(
        "prompt", F.when(F.col("on_active"), F.col("active")).when(sure >= RESUME, F.col("trace_id")).alias("work"), F.when(F.col("on_active"), 1.0).otherwise(F.round(sure, 2)).alias("confidence"), F.when(resumes, "resume").otherwise("new").alias("resolution"),
        F.when(F.col("on_active"), ids(F.col("active_reqs"))).when(sure >= RESUME, ids(reqs)).otherwise(F.expr("cast(array() as array<string>)")).alias("requirements"),
        F.when(F.col("on_active"), F.array(F.lit("active_session"))).otherwise(F.coalesce("sources", F.expr("cast(array() as array<string>)"))).alias("sources"),
    )

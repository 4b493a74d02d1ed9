"""Composite answers: status, context, pull-request report, audit bundle, plan status, request resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..schema import SEMANTIC, STALE
from ..scratch import kept
from .evidence import proof_levels
from .rules import live

# Words of a request that say nothing about its subject.
STOP_WORDS = tuple("the a an and or for with to it this that of in on is are was be make add fix change continue work also ignore using use so then now but not what when how".split())


def status(nodes: DataFrame, edges: DataFrame, runs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of counts; inactive nodes count too. With findings (and their severity) also how many of them warn."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("active")).alias("active"), F.count_if(F.col("active") & (F.col("status") == STALE)).alias("stale"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("p").isin(*SEMANTIC)).alias("semantic"))
    broken = edges.join(nodes.select(F.col("trace_id").alias("t")), "t", "left_anti").agg(F.count(F.lit(1)).alias("broken"))
    r = runs.agg(F.count(F.lit(1)).alias("runs"))
    rows = n.crossJoin(e).crossJoin(broken).crossJoin(r)  # one row each
    return rows if found is None else rows.crossJoin(found.agg(F.count_if(F.col("severity") == "WARNING").alias("warnings")))


def context(starts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Neighbours of each start: (trace_id, side, p, other, node_type, status)."""
    other = nodes.select(F.col("trace_id").alias("other"), "node_type", "status")
    # Written, so that their size is known: few starts go to the edges, and no edge is dealt out.
    starts = kept(starts.select("trace_id"), "starts")
    up = edges.join(starts.select(F.col("trace_id").alias("f")), "f", "left_semi").select(F.col("f").alias("trace_id"), F.lit("upstream").alias("side"), "p", F.col("t").alias("other"))
    down = edges.join(starts.select(F.col("trace_id").alias("t")), "t", "left_semi").select(F.col("t").alias("trace_id"), F.lit("downstream").alias("side"), "p", F.col("f").alias("other"))
    return up.unionByName(down).join(other, "other").select("trace_id", "side", "p", "other", "node_type", "status")


def changed_nodes(nodes: DataFrame, changed_paths: DataFrame) -> DataFrame:
    return nodes.filter("active").join(changed_paths.select("path"), "path", "left_semi")


def pr_report(nodes: DataFrame, edges: DataFrame, changed_paths: DataFrame, executions: DataFrame, each: int = 20) -> DataFrame:
    """(section, rank, item): at most ``each`` items a section, by name."""
    own = changed_nodes(nodes, changed_paths)
    near = edges.join(own.select(F.col("trace_id").alias("f")), "f", "left_semi").select(F.col("t").alias("trace_id")).unionByName(edges.join(own.select(F.col("trace_id").alias("t")), "t", "left_semi").select(F.col("f").alias("trace_id")))
    around = nodes.join(near.unionByName(own.select("trace_id")).distinct(), "trace_id", "left_semi")
    levels = proof_levels(edges.filter("p = 'exercises'").select(F.col("f").alias("test"), F.col("t").alias("impl")).join(own.select(F.col("trace_id").alias("impl")), "impl", "left_semi"), executions)
    parts = [
        around.filter("node_type = 'work'").select(F.lit("work").alias("section"), F.col("trace_id").alias("item")),
        around.filter("node_type = 'requirement'").select(F.lit("requirements").alias("section"), F.col("trace_id").alias("item")),
        own.filter("node_type = 'implementation'").select(F.lit("implementation").alias("section"), F.col("trace_id").alias("item")),
        levels.filter("level >= 1").select(F.lit("verification").alias("section"), F.concat("test", F.lit(" "), "impl").alias("item")),
        around.filter(F.col("status") == STALE).select(F.lit("health").alias("section"), F.col("trace_id").alias("item")),
        changed_paths.join(nodes.filter("active").select("path"), "path", "left_anti").select(F.lit("unexpected").alias("section"), F.col("path").alias("item")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("section").orderBy("item"))
    return rows.distinct().withColumn("rank", rank).filter(F.col("rank") <= each)


def audit_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each implementation: its work item, requirements and tests as one ordered chain."""
    first = edges.filter("p = 'work'").groupBy(F.col("f").alias("impl")).agg(F.min("t").alias("work"))
    reqs = edges.filter("p = 'satisfies'").groupBy(F.col("f").alias("impl")).agg(F.array_sort(F.collect_set("t")).alias("reqs"))
    tests = edges.filter("p = 'exercises'").groupBy(F.col("t").alias("impl")).agg(F.array_sort(F.collect_set("f")).alias("tests"))
    none = F.expr("cast(array() as array<string>)")
    rows = nodes.filter("active and node_type = 'implementation'").select(F.col("trace_id").alias("impl")).join(first, "impl", "left").join(reqs, "impl", "left").join(tests, "impl", "left")
    chain = F.concat(F.when(F.col("work").isNull(), none).otherwise(F.array("work")), F.coalesce("reqs", none), F.array("impl"), F.coalesce("tests", none))
    return rows.select("impl", F.array_join(chain, " > ").alias("chain"))


def excerpt(text, start, end, most_lines: int = 400, most: int = 4000):
    """Lines ``start`` to ``end`` of a text, cut by lines and by characters."""
    own = F.array_join(F.slice(F.split(text, "\n"), start, F.least(end - start + 1, F.lit(most_lines))), "\n")
    return F.when(F.length(own) <= most, own).otherwise(F.concat(F.substring(own, 1, most), F.lit("\n[cut]")))


def graph_payload(nodes: DataFrame, edges: DataFrame, most: int = 5000) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` active nodes by id, and the semantic edges between them."""
    kept = nodes.filter("active").orderBy("trace_id").limit(most)
    ids = kept.select("trace_id")
    own = edges.filter(F.col("p").isin(*SEMANTIC)).join(ids.withColumnRenamed("trace_id", "f"), "f", "left_semi").join(ids.withColumnRenamed("trace_id", "t"), "t", "left_semi")
    return kept, own


def plan_status(expects: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per plan: how many expected ids are done, unlinked and missing."""
    there = nodes.filter("active").select(F.col("trace_id").alias("expected"), F.lit(1).alias("there"))
    linked = edges.filter("p = 'implements'").select(F.col("f").alias("expected"), F.col("t").alias("plan"), F.lit(1).alias("linked")).distinct()
    rows = expects.join(there, "expected", "left").join(linked, ["expected", "plan"], "left")
    return rows.groupBy("plan").agg(F.count_if(F.col("linked").isNotNull() & F.col("there").isNotNull()).alias("done"), F.count_if(F.col("there").isNotNull() & F.col("linked").isNull()).alias("unlinked"), F.count_if(F.col("there").isNull()).alias("missing"))


def request_tokens(text):
    return F.array_except(F.array_distinct(tokens(text)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def as_json(rows: DataFrame) -> DataFrame:
    """A row of JSON for each row, fields in the order of the columns, null fields left out."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def context_text(starts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(trace_id, position, text): the lines that tell a node's surroundings: itself, then what it rests on, then what rests on it."""
    own = nodes.join(starts.select("trace_id").distinct(), "trace_id", "left_semi")
    state = F.concat(F.lit(" ["), F.upper("status"), F.lit("]"))
    head = own.select("trace_id", F.lit(0).alias("part"), F.lit("").alias("key"), F.concat(F.col("trace_id"), F.lit(" ("), "node_type", F.lit(")"), state).alias("text"))
    around = context(starts, nodes, edges)
    rows = around.select("trace_id", F.when(F.col("side") == "upstream", 1).otherwise(2).alias("part"), F.concat_ws(" ", "p", "other").alias("key"), F.concat(F.when(F.col("side") == "upstream", "  -> ").otherwise("  <- "), "p", F.lit(" "), "other", state).alias("text"))
    order = Window.partitionBy("trace_id").orderBy("part", "key")
    return head.unionByName(rows.distinct()).withColumn("position", F.row_number().over(order)).select("trace_id", "position", "text")


def audit_package(work: str, nodes: DataFrame, edges: DataFrame, changed: DataFrame, found: DataFrame, outcomes: DataFrame, most: int = 50) -> DataFrame:
    """Sections of the bundle that an auditor of one work item gets: (section, rank, trace_id, detail), at most ``most`` rows each.

    What the work item's own edges reach comes first, then by id; tests carry
    their latest outcome, findings their rule, implementations their chain.
    """
    own = edges.filter((F.col("p") == "work") & (F.col("t") == work)).select(F.col("f").alias("trace_id"))
    near = own.unionByName(edges.join(own.withColumnRenamed("trace_id", "f"), "f", "left_semi").select(F.col("t").alias("trace_id")))
    near = near.unionByName(edges.filter(F.col("p").isin("exercises", "verifies")).join(near.select(F.col("trace_id").alias("t")).distinct(), "t", "left_semi").select(F.col("f").alias("trace_id"))).distinct()
    rows = nodes.filter("active").join(near.withColumn("near", F.lit(True)), "trace_id", "left").select("trace_id", "node_type", F.coalesce("near", F.lit(False)).alias("near"))
    none = F.lit(None).cast("string")
    parts = [rows.filter(F.col("node_type") == kind).select(F.lit(name).alias("section"), "trace_id", "near", none.alias("detail")) for name, kind in (("requirements", "requirement"), ("decisions", "decision"))]
    chains = audit_paths(nodes, edges).select(F.col("impl").alias("trace_id"), F.col("chain").alias("detail"))
    parts.append(rows.filter("node_type = 'implementation'").join(chains, "trace_id").select(F.lit("implementations").alias("section"), "trace_id", "near", "detail"))
    parts.append(rows.filter("node_type = 'test'").join(outcomes.select(F.col("fid").alias("trace_id"), F.col("outcome").alias("detail")), "trace_id", "left").select(F.lit("tests").alias("section"), "trace_id", "near", "detail"))
    parts.append(changed.join(nodes.filter("active").select("path"), "path", "left_anti").select(F.lit("unexpected").alias("section"), F.col("path").alias("trace_id"), F.lit(True).alias("near"), none.alias("detail")))
    known = rows.select("trace_id", "near")
    parts.append(found.join(known, "trace_id", "left").select(F.lit("findings").alias("section"), "trace_id", F.coalesce("near", F.lit(False)).alias("near"), F.concat_ws(" ", "rule", "path", "detail").alias("detail")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    order = Window.partitionBy("section").orderBy(F.col("near").desc(), F.coalesce("trace_id", F.lit("")), F.coalesce("detail", F.lit("")))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("section", "rank", "trace_id", "detail")


def excerpts(selected: DataFrame, texts: DataFrame, most_lines: int = 400, most: int = 2000) -> DataFrame:
    """(trace_id, excerpt) of nodes (trace_id, path, s, e): their lines in ``texts`` (path, text), at most so many lines and characters, no white space at the ends."""
    own = selected.filter("path is not null").select("trace_id", "path", F.greatest(F.lit(1), F.coalesce("s", F.lit(1))).alias("s"), "e")
    rows = own.join(texts.select("path", "text"), "path")
    count = F.greatest(F.lit(0), F.least(F.coalesce("e", F.size("lines")) - F.col("s") + 1, F.lit(most_lines)))
    rows = rows.withColumn("lines", F.split("text", "\n")).withColumn("cut", F.array_join(F.slice("lines", F.col("s"), count), "\n"))
    return rows.select("trace_id", F.substring(F.regexp_replace("cut", r"^\s+|\s+$", ""), 1, most).alias("excerpt"))


def suspects(nodes: DataFrame, edges: DataFrame, listed: DataFrame, expects: DataFrame, symbol=None, most: int = 50) -> DataFrame:
    """(section, rank, trace_id, detail): what an auditor must judge, in the order of kind and ids, at most ``most``.

    ``misleading_test``: a test whose first exercised implementation among
    ``listed`` (section, trace_id, excerpt) is named by neither id nor ``symbol``
    in the test's excerpt; ``drift``: an implementation that awaits a review;
    ``plan_gap``: something that a plan expects and no implements edge links.
    """
    active = nodes.filter("active")
    impls = listed.filter("section = 'implementations'").select(F.col("trace_id").alias("impl"))
    named = active.select(F.col("trace_id").alias("impl"), F.coalesce(symbol if symbol is not None else F.lit(None).cast("string"), F.lit("")).alias("symbol"))
    pairs = edges.filter("p = 'exercises'").select(F.col("f").alias("trace_id"), F.col("t").alias("impl")).join(impls, "impl", "left_semi")
    first = pairs.join(active.filter("node_type = 'test'").select("trace_id"), "trace_id", "left_semi").groupBy("trace_id").agg(F.min("impl").alias("impl")).join(named, "impl")
    seen = listed.filter("section = 'tests'").select("trace_id", F.col("excerpt").alias("said"))
    first = first.join(seen, "trace_id", "left").withColumn("said", F.coalesce("said", F.lit("")))
    misleading = first.filter((F.col("symbol") != "") & ~F.col("said").contains(F.col("symbol")) & ~F.col("said").contains(F.col("impl"))).select(F.lit(0).alias("kind"), "trace_id", F.concat(F.lit("misleading_test "), "impl").alias("detail"))
    drift = active.filter((F.col("node_type") == "implementation") & (F.col("status") == STALE)).select(F.lit(1).alias("kind"), "trace_id", F.lit("drift").alias("detail"))
    linked = live(edges).filter("p = 'implements'").select(F.col("f").alias("expected"), F.col("t").alias("plan")).join(nodes.select(F.col("trace_id").alias("expected")), "expected", "left_semi").distinct()
    plans = active.filter("node_type = 'plan'").select(F.col("trace_id").alias("plan"))
    gaps = expects.join(plans, "plan", "left_semi").join(linked, ["plan", "expected"], "left_anti").select(F.lit(2).alias("kind"), F.col("plan").alias("trace_id"), F.concat(F.lit("plan_gap "), "expected").alias("detail"))
    # The first rows by order, merged from each task's first ones.
    rows = misleading.unionByName(drift).unionByName(gaps).distinct().orderBy("kind", "trace_id", "detail").limit(most)
    return rows.select(F.lit("suspects").alias("section"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("kind", "trace_id", "detail")).alias("rank"), "trace_id", "detail")


def audit_bundle(work: str, nodes: DataFrame, edges: DataFrame, texts: DataFrame, changed: DataFrame, found: DataFrame, outcomes: DataFrame, expects: DataFrame, *, symbol=None, most: int = 50, most_lines: int = 400, most_chars: int = 2000) -> DataFrame:
    """What an auditor of one work item gets: (section, rank, trace_id, detail, excerpt).

    ``audit_package``, with the source of each requirement, decision,
    implementation and test that it lists cut from ``texts``, and the
    ``suspects``.  Only listed nodes meet the texts.
    """
    rows = kept(audit_package(work, nodes, edges, changed, found, outcomes, most), "audit")
    own = rows.filter(F.col("section").isin("requirements", "decisions", "implementations", "tests")).select("trace_id").distinct()
    cut = excerpts(nodes.join(F.broadcast(own), "trace_id", "left_semi"), texts, most_lines, most_chars)
    shown = rows.filter(F.col("section").isin("requirements", "decisions", "implementations", "tests")).join(cut, "trace_id", "left").unionByName(rows.filter(~F.col("section").isin("requirements", "decisions", "implementations", "tests")).withColumn("excerpt", F.lit(None).cast("string")))
    shown = kept(shown.select("section", "rank", "trace_id", "detail", "excerpt"), "audit-shown")
    return shown.unionByName(suspects(nodes, edges, shown, expects, symbol, most).withColumn("excerpt", F.lit(None).cast("string")))


def bundle_json(bundle: DataFrame, work: str) -> DataFrame:
    """The bundle as one JSON document: schema, work, status and a list a section; bounded by its sections' caps."""
    item = F.struct(F.col("trace_id").alias("id"), "detail", "excerpt")
    per = bundle.groupBy("section").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("x")))), lambda r: r["x"]).alias("items"))
    failed = F.coalesce(F.bool_or(F.col("section") == "findings"), F.lit(False))
    rows = per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "items")))).alias("sections"), failed.alias("failed"))
    return rows.select(F.to_json(F.struct(F.lit("audit-package/v1").alias("schema"), F.lit(work).alias("work"), F.when(F.col("failed"), "fail").otherwise("pass").alias("status"), "sections")).alias("json"))

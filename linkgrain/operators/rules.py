"""Policy rules: each takes a graph and gives findings (rule, trace_id, path, line, detail).

Nodes: trace_id, node_type, path, s, e, status, active.  Edges: f, p, t, and
status, of which rules read the active ones.  A rule
reads only the columns it needs, and anti and semi joins keep one shuffle of
narrow keys.  ``scope`` limits a rule to changed ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_glob, loose_glob
from ..schema import OBSERVED, SEMANTIC, STALE
from ..scratch import dealt


@dataclass
class Context:
    """What rules look at; frames that a rule does not read may be missing."""

    nodes: DataFrame
    edges: DataFrame
    runs: DataFrame | None = None
    results: DataFrame | None = None
    executions: DataFrame | None = None
    expects: DataFrame | None = None
    changed_paths: DataFrame | None = None
    scope: DataFrame | None = None
    stored: DataFrame | None = None
    waivers: DataFrame | None = None
    boundaries: DataFrame | None = None
    revision: str | None = None
    lifecycle: str = "wip"
    today: str = "2024-02-01"
    per_test: bool = False
    audit: dict | DataFrame | None = None
    exclusions: list[str] = field(default_factory=list)
    # Files, and folders that end in a slash, whose change alters enforcement.
    enforcement: tuple[str, ...] = (".trace/policy.toml", ".trace/trace.toml", ".trace/policy/", ".trace/schema/")

    def scoped(self) -> DataFrame:
        nodes = self.nodes.filter("active")
        return nodes if self.scope is None else nodes.join(self.scope.select("trace_id"), "trace_id", "left_semi")

    @property
    def live(self) -> DataFrame:
        return live(self.edges)

    def of_type(self, kind: str) -> DataFrame:
        return self.scoped().filter(F.col("node_type") == kind)


def live(edges: DataFrame) -> DataFrame:
    """Edges that count: the active ones, where they have a status."""
    return edges.filter("status = 'active'") if "status" in edges.columns else edges


def findings(rows: DataFrame, rule: str, trace_id="trace_id", path="path", detail: Column | None = None, line: str | None = None) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    none = F.lit(None).cast("string")
    return rows.select(
        F.lit(rule).alias("rule"), (none if trace_id is None else as_col(trace_id)).alias("trace_id"), (none if path is None else as_col(path)).alias("path"),
        (none if line is None else F.col(line)).cast("int").alias("line"), (none if detail is None else detail).cast("string").alias("detail"),
    )


def stored(rule: str) -> Callable[[Context], DataFrame]:
    """Findings of the last index run, given again."""

    def run(ctx: Context) -> DataFrame | None:
        return None if ctx.stored is None else ctx.stored.filter(F.col("rule") == rule).select("rule", "trace_id", "path", "line", "detail")

    return run


def missing_target(ctx: Context) -> DataFrame:
    """Active edges to no node, at the place that declares them; where edges have no path, at their source's."""
    lost = ctx.live.join(dealt(ctx.nodes.select(F.col("trace_id").alias("t"))), "t", "left_anti")
    if "path" in ctx.edges.columns:
        known = F.when(F.col("own").isNotNull(), F.col("f"))
        lost = lost.join(dealt(ctx.nodes.select(F.col("trace_id").alias("f"), F.lit(True).alias("own"))), "f", "left")
        return findings(lost, "TL002", known, detail=F.concat("p", F.lit(" -> "), "t"), line="line" if "line" in lost.columns else None)
    return findings(lost.join(dealt(ctx.nodes.select(F.col("trace_id").alias("f"), "path")), "f", "left"), "TL002", "f", detail=F.concat("p", F.lit(" -> "), "t"))


def detached(ctx: Context) -> DataFrame | None:
    if "attachment" not in ctx.nodes.columns:
        return None
    loose = F.col("attachment").isin("file", "ambiguous") & F.col("parser").isNotNull() & (F.col("parser") != "generic")
    return findings(ctx.nodes.filter("active").filter(F.coalesce(F.col("detached"), F.lit(False)) | loose), "TL003", detail=F.col("attachment"), line="s")


def no_ancestry(ctx: Context) -> DataFrame:
    have = ctx.live.filter(F.col("p").isin("work", "satisfies")).select(F.col("f").alias("trace_id"))
    return findings(ctx.of_type("implementation").join(dealt(have), "trace_id", "left_anti"), "TL010", line="s")


def stale_downstream(ctx: Context) -> DataFrame:
    sources = ctx.nodes.filter(F.col("status") == STALE).select(F.col("trace_id").alias("f"))
    hit = ctx.live.filter(F.col("p").isin(*SEMANTIC)).join(dealt(sources), "f", "left_semi").withColumnRenamed("t", "trace_id")
    return findings(ctx.of_type("requirement").join(dealt(hit), "trace_id"), "TL011", detail=F.concat("f", F.lit(" "), "p"), line="s")


def unclaimed_path(ctx: Context) -> DataFrame | None:
    if ctx.changed_paths is None:
        return None
    rest = ctx.changed_paths.select("path").distinct().filter(~any_glob(F.col("path"), ctx.exclusions, loose_glob))
    return findings(rest.join(dealt(ctx.nodes.filter("active").select("path").distinct()), "path", "left_anti"), "TL012", None)


def untraced_boundary(ctx: Context) -> DataFrame | None:
    """``boundaries``: path, name, line, changed, traced."""
    if ctx.boundaries is None:
        return None
    rest = ctx.boundaries.filter(F.col("changed") & ~F.col("traced")).filter(~any_glob(F.col("path"), ctx.exclusions, loose_glob))
    return findings(rest, "TL013", None, detail=F.col("name"), line="line")


def plan_gap(ctx: Context) -> DataFrame | None:
    """``expects``: plan, expected."""
    if ctx.expects is None:
        return None
    plans = ctx.nodes.filter("active and node_type = 'plan'").select(F.col("trace_id").alias("plan"), "path", "s")
    there = ctx.nodes.filter("active").select(F.col("trace_id").alias("expected"), F.lit(True).alias("exists"))
    linked = ctx.live.filter("p = 'implements'").select(F.col("f").alias("expected"), F.col("t").alias("plan"), F.lit(True).alias("linked")).distinct()
    rows = ctx.expects.join(dealt(plans), "plan").join(dealt(there), "expected", "left").join(dealt(linked), ["expected", "plan"], "left")
    why = F.when(F.col("exists").isNull(), "missing").when(F.col("linked").isNull(), "unlinked")
    return findings(rows.filter(why.isNotNull()), "TL014", "plan", detail=F.concat("expected", F.lit(" "), why), line="s")


def unverified(ctx: Context) -> DataFrame:
    have = ctx.live.filter("p = 'verifies'").select(F.col("t").alias("trace_id"))
    return findings(ctx.of_type("requirement").join(dealt(have), "trace_id", "left_anti"), "TL020", line="s")


def latest_run(runs: DataFrame, revision: str | None) -> DataFrame:
    """The latest run by start, then id; of one revision if given."""
    runs = runs if revision is None else runs.filter(F.col("revision") == revision)
    return runs.orderBy(F.col("started_at").desc_nulls_last(), F.col("run_id").desc()).limit(1)


def test_not_passed(ctx: Context) -> DataFrame | None:
    """A linked test without a pass in the latest run.

    A result bound to the test's own id decides; else one unbound result with
    the test's id or framework id does, the first by framework id.
    """
    if ctx.runs is None or ctx.results is None:
        return None
    reqs = ctx.of_type("requirement").select(F.col("trace_id").alias("t"))
    linked = ctx.live.filter("p = 'verifies'").join(dealt(reqs), "t", "left_semi").groupBy("f").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("reqs"))
    tests = linked.join(dealt(ctx.nodes.filter("node_type is not null").select(F.col("trace_id").alias("f"), "path", "s", *([F.col("framework_test_id")] if "framework_test_id" in ctx.nodes.columns else []))), "f")
    run = F.broadcast(latest_run(ctx.runs, ctx.revision).select("run_id"))
    results = ctx.results.join(run, "run_id", "left_semi")
    bound = "test" in results.columns
    by_uid = results.filter("test is not null").groupBy(F.col("test").alias("f")).agg(F.min_by("outcome", "fid").alias("own")) if bound else None
    free = results.filter("test is null") if bound else results
    names = F.array(F.col("f"), F.col("framework_test_id")) if "framework_test_id" in tests.columns else F.array(F.col("f"))
    by_name = tests.select("f", F.explode(names).alias("fid")).join(dealt(free), "fid").groupBy("f").agg(F.min_by("outcome", "fid").alias("named"))
    out = tests.join(dealt(by_name), "f", "left")
    out = out.join(dealt(by_uid), "f", "left") if by_uid is not None else out.withColumn("own", F.lit(None).cast("string"))
    return findings(out.filter(F.coalesce("own", "named", F.lit("none")) != "pass"), "TL021", "f", detail=F.col("reqs"), line="s")


def proof_levels(pairs: DataFrame, executions: DataFrame) -> DataFrame:
    """``pairs`` (test, impl) with level: 3 behavioural, 2 any record of the pair, 1 a suite record of the implementation, 0 none."""
    own = executions.groupBy("test", "impl").agg(F.max(F.when(F.col("behavioral"), 3).otherwise(2)).alias("own"))
    suite = executions.filter("kind = 'suite'").groupBy("impl").agg(F.lit(1).alias("suite"))
    return pairs.join(dealt(own), ["test", "impl"], "left").join(dealt(suite), "impl", "left").select("test", "impl", F.coalesce("own", "suite", F.lit(0)).cast("int").alias("level"))


def weak_evidence(ctx: Context) -> DataFrame | None:
    if ctx.executions is None:
        return None
    required = 2 if ctx.per_test else 1
    current = ctx.revision is None or not latest_run(ctx.runs, ctx.revision).isEmpty()
    impls = ctx.of_type("implementation").select(F.col("trace_id").alias("impl"), "path", "s")
    pairs = ctx.live.filter("p = 'exercises'").select(F.col("f").alias("test"), F.col("t").alias("impl")).join(dealt(impls.select("impl")), "impl", "left_semi")
    weak = proof_levels(pairs, ctx.executions).filter((F.col("level") < required) | F.lit(not current))
    return findings(weak.join(dealt(impls), "impl"), "TL022", "impl", detail=F.concat("test", F.lit(" "), F.col("level").cast("string")), line="s")


def deleted_but_linked(ctx: Context) -> DataFrame:
    gone = ctx.nodes.filter("not active").select(F.col("trace_id").alias("t"), "path", "s")
    gone = gone if ctx.scope is None else gone.join(ctx.scope.select(F.col("trace_id").alias("t")), "t", "left_semi")
    live = ctx.live.filter(~F.col("p").isin(*OBSERVED))
    first = live.join(dealt(gone), "t").groupBy("t").agg(F.first("path").alias("path"), F.first("s").alias("s"), F.min(F.struct("f", "p")).alias("e"))
    return findings(first, "TL030", "t", detail=F.concat("e.f", F.lit(" "), "e.p"), line="s")


def other_revision(ctx: Context) -> DataFrame | None:
    if ctx.runs is None or ctx.revision is None:
        return None
    return findings(ctx.runs.filter(F.col("revision") != ctx.revision), "TL050", None, None, F.concat("run_id", F.lit(" "), "revision"))


def audit_missing(ctx: Context) -> DataFrame | None:
    """``audit``: a result with its ``schema``, or a table of such; one of the known schema is enough."""
    known, one = "audit-result/v1", ctx.nodes.sparkSession.range(1)
    if isinstance(ctx.audit, DataFrame):
        sound = ctx.audit.filter(F.col("schema").endswith(known)).select(F.lit(0).cast("long").alias("id")).limit(1)
        one = one.join(sound, "id", "left_anti")
    elif ctx.audit and str(ctx.audit.get("schema", "")).endswith(known):
        return None
    return findings(one, "TL060", None, None, F.lit("no audit result"))


def expired_waiver(ctx: Context) -> DataFrame | None:
    if ctx.waivers is None:
        return None
    return findings(ctx.waivers.filter(F.col("expires") < F.lit(ctx.today).cast("date")), "TL061", detail=F.concat("rule", F.lit(" "), F.col("expires").cast("string")))


def unbound_run(ctx: Context) -> DataFrame | None:
    if ctx.runs is None or ctx.revision is None:
        return None
    return findings(ctx.runs.filter("revision is null"), "TL062", None, None, F.col("run_id"))


def enforcement_changed(ctx: Context) -> DataFrame | None:
    if ctx.changed_paths is None:
        return None
    hit = F.lit(False)
    for p in ctx.enforcement:
        hit = hit | (F.col("path").startswith(p) if p.endswith("/") else F.col("path") == p)
    return findings(ctx.changed_paths.select("path").distinct().filter(hit), "TL063", None)


def stale_blocks(ctx: Context) -> DataFrame | None:
    if ctx.lifecycle not in ("merge", "release"):
        return None
    return findings(ctx.scoped().filter(F.col("status") == STALE), "TL110", detail=F.lit(ctx.lifecycle), line="s")


def duplicate_ids(declared: DataFrame) -> DataFrame:
    """TL001: every declaration of an id that is declared more than once."""
    more = declared.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return findings(declared.join(dealt(more), "trace_id"), "TL001", detail=F.col("n"), line="s")


REGISTRY: dict[str, Callable[[Context], DataFrame | None]] = {
    "TL001": stored("TL001"), "TL002": missing_target, "TL003": detached, "TL004": stored("TL004"), "TL005": stored("TL005"), "TL006": stored("TL006"), "TL007": stored("TL007"),
    "TL010": no_ancestry, "TL011": stale_downstream, "TL012": unclaimed_path, "TL013": untraced_boundary, "TL014": plan_gap,
    "TL020": unverified, "TL021": test_not_passed, "TL022": weak_evidence, "TL030": deleted_but_linked, "TL040": stored("TL040"),
    "TL050": other_revision, "TL051": stored("TL051"), "TL060": audit_missing, "TL061": expired_waiver, "TL062": unbound_run, "TL063": enforcement_changed,
    "TL100": stored("TL100"), "TL110": stale_blocks,
}

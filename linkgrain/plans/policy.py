"""Profiles, gates and waivers: which rules run, and what their findings mean."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import REGISTRY, Context, findings
from ..scratch import dealt, kept

# Severities by rule, rules by profile (each adds to the one before), gates.
WARNINGS = ("TL003", "TL013", "TL050", "TL062", "TL063")
PROFILES = {
    "minimal": "TL001 TL002 TL003 TL004 TL005 TL006 TL007 TL040".split(),
    "standard": "TL010 TL011 TL012 TL013 TL014 TL020 TL021 TL100".split(),
    "strict": "TL022 TL030 TL061".split(),
    "safety-critical": "TL050 TL060 TL062".split(),
}
GATES = {"TL010": "work_ancestry", "TL011": "requirement", "TL020": "verifying_test", "TL021": "test_pass", "TL022": "execution_evidence", "TL060": "semantic_audit", "TL110": "block_stale"}
MERGE_GATES = {"minimal": (), "standard": ("work_ancestry", "requirement", "verifying_test", "test_pass", "block_stale")}
MERGE_GATES["strict"] = MERGE_GATES["safety-critical"] = (*MERGE_GATES["standard"], "execution_evidence")
LIFECYCLES = ("draft", "wip", "review", "merge", "release")


def gates(profile: str, lifecycle: str, overrides: dict[str, bool] | None = None) -> set[str]:
    """Names of the gates that are open: the profile's, then what the policy sets itself."""
    on = set(MERGE_GATES.get(profile, ())) if lifecycle in ("merge", "release") else set()
    if profile == "safety-critical":
        on.add("execution_evidence")
    if lifecycle == "release" and profile in ("strict", "safety-critical"):
        on.add("semantic_audit")
    for name, value in (overrides or {}).items():
        (on.add if value else on.discard)(name)
    return on


def enabled(profile: str, lifecycle: str, overrides: dict[str, bool] | None = None) -> list[str]:
    """Rules that run: those of the profile that have no gate, and those whose gate is open."""
    names = list(PROFILES)
    known = names.index(profile) if profile in names else 0
    base = {r for p in names[: known + 1] for r in PROFILES[p]}
    if known and lifecycle in ("merge", "release"):
        base.add("TL110")
    on = gates(profile, lifecycle, overrides)
    return sorted({r for r in base if r not in GATES} | {r for r, g in GATES.items() if g in on})


def waived(found: DataFrame, waivers: DataFrame | None, today: str) -> DataFrame:
    """Findings with severity; an unexpired waiver of the rule, and of the id and path where it names them, makes it INFO.

    The first waiver by ``pos`` counts and ``waiver`` names its owner, else its
    reason; TL061 cannot be waived.  Waivers meet the findings' distinct keys by
    equality: each key asks with its id and path or without them, as far as a waiver of its rule does.
    """
    severity = F.when(F.col("rule").isin(*WARNINGS), "WARNING").otherwise("ERROR")
    found = found.withColumn("severity", severity)
    if waivers is None:
        return found.withColumn("waiver", F.lit(None).cast("string"))
    said = F.coalesce("owner", "reason") if "reason" in waivers.columns else F.col("owner")
    w = waivers.filter(F.col("expires").isNull() | (F.col("expires") >= F.lit(today).cast("date"))).filter("rule <> 'TL061'")
    w = w.select("rule", F.col("trace_id").alias("w_id"), F.col("path").alias("w_path"), F.struct(said.alias("by")).alias("w"), "pos")
    keys = found.select("rule", "trace_id", "path").distinct()
    none = F.lit(None).cast("string")
    ways = F.array_distinct(F.array(*[F.struct(i.alias("w_id"), p.alias("w_path")) for i in (F.col("trace_id"), none) for p in (F.col("path"), none)]))
    asked = keys.select("*", F.explode(ways).alias("x")).select("rule", "trace_id", "path", F.col("x.w_id").alias("i"), F.col("x.w_path").alias("p"))
    shapes = w.select(F.col("rule").alias("r"), F.isnull("w_id").alias("no_id"), F.isnull("w_path").alias("no_path")).distinct()
    asked = asked.join(F.broadcast(shapes), (F.col("rule") == F.col("r")) & (F.isnull("i") == F.col("no_id")) & (F.isnull("p") == F.col("no_path")), "left_semi")  # at most four a rule
    met = asked.join(dealt(w.withColumnRenamed("rule", "r")), (F.col("rule") == F.col("r")) & F.col("i").eqNullSafe(F.col("w_id")) & F.col("p").eqNullSafe(F.col("w_path")))
    met = met.groupBy(F.col("rule").alias("r"), F.col("trace_id").alias("i"), F.col("path").alias("p")).agg(F.min_by("w", F.struct(F.col("pos").isNull(), "pos")).alias("w"))
    rows = found.join(dealt(met), (F.col("rule") == F.col("r")) & F.col("trace_id").eqNullSafe(F.col("i")) & F.col("path").eqNullSafe(F.col("p")), "left")
    return rows.select(*[c for c in found.columns if c != "severity"], F.when(F.col("w").isNotNull(), "INFO").otherwise(F.col("severity")).alias("severity"), F.col("w.by").alias("waiver"))


def ordered(found: DataFrame) -> DataFrame:
    """Findings by rule, id, path, line and detail, null before all."""
    return found.orderBy("rule", F.coalesce("trace_id", F.lit("")), F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(-1)), "detail")


def evaluate(ctx: Context, profile: str, overrides: dict[str, bool] | None = None, allow_waivers: bool = True, apart: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """The union of all enabled rules' findings with severities, and with waivers where the policy allows them.

    A profile that there is not gives TL100, and the minimal rules run.  ``only``
    names the rules whose findings are asked for, if not all are.  ``apart``
    stores each rule's findings first, one rule after the other, for whole
    graphs: the driver then never plans and follows more than one rule, and only
    findings of rules that a waiver names meet the waivers.
    """
    found = {}
    if profile not in PROFILES:
        found["TL100"] = findings(ctx.nodes.sparkSession.range(1), "TL100", None, None, F.lit(f"unknown profile {profile}"))
    for rule in enabled(profile, ctx.lifecycle, overrides):
        rows = REGISTRY[rule](ctx) if not only or rule in only else None
        if rows is not None:
            rows = kept(rows, f"findings-{rule}") if apart else rows
            found[rule] = found[rule].unionByName(rows) if rule in found else rows
    if not found:
        found[""] = ctx.nodes.sparkSession.createDataFrame([], "rule string, trace_id string, path string, line int, detail string")
    waivers = ctx.waivers if allow_waivers else None
    whole = lambda names: functools.reduce(DataFrame.unionByName, [found[r] for r in names])
    if not apart or waivers is None:
        return waived(whole(found), waivers, ctx.today)
    named = {r["rule"] for r in waivers.filter(F.col("rule").isin(*found)).select("rule").distinct().collect()}  # rules at most
    parts = [waived(whole(rules), w, ctx.today) for rules, w in (([r for r in found if r in named], waivers), ([r for r in found if r not in named], None)) if rules]
    return functools.reduce(DataFrame.unionByName, parts)


def both_scopes(changed: Context, whole: Context, profile: str, overrides: dict[str, bool] | None = None) -> DataFrame:
    """What a stop gate asks: the findings of the change and those of the whole graph, each once; an error of either blocks."""
    return evaluate(changed, profile, overrides).unionByName(evaluate(whole, profile, overrides)).distinct()


def of_kind(found: DataFrame, *, rules: tuple[str, ...] = (), severities: tuple[str, ...] = (), paths: DataFrame | None = None) -> DataFrame:
    """Findings of some rules, severities and paths; what is not given does not limit."""
    for column, values in (("rule", rules), ("severity", severities)):
        found = found.filter(F.col(column).isin(*values)) if values else found
    return found if paths is None else found.join(paths.select("path").distinct(), "path", "left_semi")


def blocking(found: DataFrame) -> DataFrame:
    """One row: findings by severity, and whether an ERROR is left."""
    return found.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("ERROR", "WARNING", "INFO")], F.coalesce(F.bool_or(F.col("severity") == "ERROR"), F.lit(False)).alias("blocking"))

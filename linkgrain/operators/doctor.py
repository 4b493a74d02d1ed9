"""Doctor: what is wrong with an index, and what could be done about it; nothing is changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import STALE
from .history import old_paths
from .rules import live

COLUMNS = ("rule", "severity", "trace_id", "path", "line", "detail")


def _rows(rows: DataFrame, rule: str, severity: str, trace_id, path, line, detail) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), trace_id.alias("trace_id"), path.alias("path"), line.cast("int").alias("line"), detail.alias("detail"))


def examined(nodes: DataFrame, edges: DataFrame, declarations: DataFrame, *, stored: DataFrame | None = None, commits: DataFrame | None = None, migration: DataFrame | None = None) -> DataFrame:
    """Findings (COLUMNS), each once.

    TL002 edges with a missing end; TL001 ids declared at several places; TL003
    and TL040 of the last run (``stored``) and nodes marked as detached; stale
    nodes; nodes at a path that another node's path was renamed from; older
    annotations (``migration``: path, line, class) that need a review.
    """
    none = F.lit(None).cast("string")
    ids = nodes.select("trace_id")
    active = live(edges)
    no_target = active.join(ids.withColumnRenamed("trace_id", "t"), "t", "left_anti").select("f", "p", F.col("t").alias("missing"))
    no_source = active.join(ids.withColumnRenamed("trace_id", "t"), "t", "left_semi").join(ids.withColumnRenamed("trace_id", "f"), "f", "left_anti").select("f", "p", F.col("f").alias("missing"))
    lost = no_target.unionByName(no_source)
    out = _rows(lost, "TL002", "ERROR", F.col("f"), none, F.lit(None), F.concat("p", F.lit(" misses "), "missing"))
    places = declarations.select("trace_id", "path", "line").distinct()
    many = places.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = out.unionByName(_rows(places.join(many, "trace_id"), "TL001", "ERROR", F.col("trace_id"), F.col("path"), F.col("line"), F.concat(F.lit("declared at "), F.col("n").cast("string"), F.lit(" places"))))
    if "detached" in nodes.columns:
        out = out.unionByName(_rows(nodes.filter("active and detached"), "TL003", "WARNING", F.col("trace_id"), F.col("path"), F.lit(None), F.lit("detached")))
    if stored is not None:
        again = stored.filter(F.col("rule").isin("TL003", "TL040"))
        out = out.unionByName(again.select("rule", F.when(F.col("rule") == "TL003", "WARNING").otherwise("ERROR").alias("severity"), "trace_id", "path", F.col("line").cast("int").alias("line"), "detail"))
    out = out.unionByName(_rows(nodes.filter(F.col("active") & (F.col("status") == STALE)), "TL110", "INFO", F.col("trace_id"), F.col("path"), F.lit(None), F.lit("review")))
    if commits is not None:
        renamed = old_paths(nodes.select("path").filter("path is not null").distinct(), commits)
        # The first node by id at the old path; the candidate is each node at the new one.
        left = nodes.groupBy(F.col("path").alias("old_path")).agg(F.min("trace_id").alias("other"))
        near = renamed.join(left, "old_path").join(nodes.select("path", "trace_id"), "path").filter("other <> trace_id")
        out = out.unionByName(_rows(near, "TL005", "INFO", F.col("other"), F.col("path"), F.lit(None), F.concat(F.lit("renamed from "), "old_path", F.lit("; candidate "), "trace_id")))
    if migration is not None:
        review = migration.filter("class in ('derived', 'requires_review')")
        out = out.unionByName(_rows(review, "TL040", "INFO", none, F.col("path"), F.col("line"), F.concat(F.lit("migration "), "class")))
    return out.distinct()


def ordered(found: DataFrame) -> DataFrame:
    """By rule, path, line, id and detail, null before all."""
    return found.orderBy("rule", F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)), F.coalesce("trace_id", F.lit("")), "detail")

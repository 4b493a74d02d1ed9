"""Change data: upserts, fingerprint history, staleness, incremental merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CURRENT, HISTORICAL, STALE
from ..scratch import kept
from .rules import live


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with their key."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the one with the largest ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def changed(current: DataFrame, versions: DataFrame) -> DataFrame:
    """Ids with a recorded fingerprint other than the present one."""
    v = versions.select("trace_id", F.col("fingerprint").alias("other"))
    return current.select("trace_id", "fingerprint").join(v, "trace_id").filter("other <> fingerprint").select("trace_id").distinct()


def drift(versions: DataFrame) -> DataFrame:
    """Each version with the fingerprint before it, oldest first; an id's history is one window."""
    order = Window.partitionBy("trace_id").orderBy("observed", "fingerprint")
    return versions.select("trace_id", "observed", "fingerprint", F.lag("fingerprint").over(order).alias("before"))


def staleness(nodes: DataFrame, edges: DataFrame, changed_ids: DataFrame) -> DataFrame:
    """Nodes with the status after a change: sources of declared, active edges into changed nodes go stale, one hop, and their evidence is historical.

    That comes after the changed nodes' own reset, so a changed node can end
    stale itself.
    """
    declared = live(edges).filter("kind = 'declared'") if "kind" in edges.columns else live(edges)
    sources = declared.join(changed_ids.select(F.col("trace_id").alias("t")), "t", "left_semi").select(F.col("f").alias("trace_id"), F.lit(True).alias("hit")).distinct()
    reset = changed_ids.select("trace_id", F.lit(True).alias("changed"))
    rows = nodes.join(reset, "trace_id", "left").join(sources, "trace_id", "left")
    hit = F.col("active") & F.col("hit")
    return rows.withColumn("was", F.when(F.col("changed"), CURRENT).otherwise(F.col("status"))).withColumn("status", F.when(hit, STALE).when(F.col("changed"), CURRENT).otherwise(F.col("status"))).withColumn("changed", F.coalesce("changed", F.lit(False))).withColumn("evidence_status", F.when(hit & (F.col("was") != STALE), HISTORICAL)).drop("hit", "was")


def first_declarations(declared: DataFrame) -> DataFrame:
    """One node an id: the first declaration by path, then line."""
    rest = [c for c in declared.columns if c != "trace_id"]
    order = F.struct("path", F.col("s"), F.col("node_type"))
    return declared.groupBy("trace_id").agg(F.min_by(F.struct(*rest), order).alias("r")).select("trace_id", "r.*")


def merged_index(previous: DataFrame, parsed: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """Nodes after an incremental run: rows of changed paths are replaced, ids that vanished stay as inactive rows."""
    # Written, so that their size is known: few paths go to the rows, and all rows of one path do not meet in a task.
    paths = kept(changed_paths.select("path").filter("path is not null").distinct().withColumn("_read", F.lit(True)), "paths")
    rest = previous.join(parsed.select("trace_id"), "trace_id", "left_anti").join(paths, "path", "left")
    return parsed.unionByName(rest.withColumn("active", F.when(F.col("_read"), False).otherwise(F.col("active"))).select(parsed.columns))


def inactive_except(nodes: DataFrame, keep: DataFrame) -> DataFrame:
    here = keep.select("trace_id", F.lit(True).alias("keep")).distinct()
    return nodes.join(here, "trace_id", "left").withColumn("active", F.col("active") & F.coalesce("keep", F.lit(False))).drop("keep")


def owner_closure(edges: DataFrame) -> DataFrame:
    """Requirements of each work item: those tied to it, and those its implementations satisfy."""
    direct = edges.filter("p = 'work' and f like 'REQ-%'").select(F.col("t").alias("work"), F.col("f").alias("req"))
    impl = edges.filter("p = 'work'").select(F.col("t").alias("work"), "f").join(edges.filter("p = 'satisfies'").select("f", F.col("t").alias("req")), "f").select("work", "req")
    return direct.unionByName(impl).distinct()


def sole_satisfier(edges: DataFrame) -> DataFrame:
    """The implementation that alone satisfies a requirement, else null."""
    per = edges.filter("p = 'satisfies'").groupBy(F.col("t").alias("req")).agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("one"))
    return per.select("req", F.when(F.col("n") == 1, F.col("one")).alias("impl"))


def patched(rows: DataFrame, updates: DataFrame, key: str = "trace_id") -> DataFrame:
    """``rows`` with the values of ``updates``, which has a row a key: a null leaves a value as it is."""
    columns = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    out = rows.join(new, key, "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def edge_status(edges: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """``edges`` with a status for those from the nodes ``ids``."""
    hit = ids.select(F.col("trace_id").alias("f"), F.lit(status).alias("new")).distinct()
    return edges.join(hit, "f", "left").select(*[F.coalesce("new", c).alias(c) if c == "status" else F.col(c) for c in edges.columns])


def recorded_versions(old: DataFrame, seen: DataFrame) -> DataFrame:
    """Versions (trace_id, fingerprint, observed): one row a fingerprint with the latest observation."""
    return old.unionByName(seen).groupBy("trace_id", "fingerprint").agg(F.max("observed").alias("observed"))


def recorded_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings by uid, each once, the new ones in place of old ones with their uid."""
    from ..functions.ids import diagnostic_uid

    uid = diagnostic_uid(F.col("rule"), F.col("trace_id"), F.col("path"), F.col("line"), F.col("detail"))
    keyed = lambda rows: rows.withColumn("uid", uid).dropDuplicates(["uid"])
    return upsert(keyed(old), keyed(new), ["uid"])


def carried(nodes: DataFrame, before: DataFrame, clean: bool = False) -> DataFrame:
    """``nodes`` with the status that they had before, unless that was current or the run is a ``clean`` one; ``staleness`` resets the changed ones after it."""
    if clean:
        return nodes
    old = before.select("trace_id", F.col("status").alias("was"))
    keep = F.col("was").isNotNull() & (F.col("was") != CURRENT)
    return nodes.join(old, "trace_id", "left").withColumn("status", F.when(keep, F.col("was")).otherwise(F.col("status"))).drop("was")

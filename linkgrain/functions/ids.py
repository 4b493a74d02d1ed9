"""Identity: deterministic uids, id syntax, type by prefix, slugs and new ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_PATTERN = r"^[A-Za-z0-9._:/\-]+$"

# The first prefix that fits gives the type.
TYPE_PREFIXES = (
    ("REQ-", "requirement"), ("NFR-", "nfr"), ("ADR-", "decision"), ("WORK-", "work"), ("PLAN-", "plan"), ("impl.", "implementation"), ("test.", "test"),
    ("ops.", "operation"), ("doc.", "document"), ("runbook.", "runbook"), ("prompt.", "prompt"), ("config.", "config"), ("data.", "data"),
    ("PRD-", "prd"), ("prd.", "prd"), ("GOAL-", "goal"), ("goal.", "goal"), ("EV-", "evidence"), ("EVIDENCE-", "evidence"), ("CI-", "ci_run"),
)


def digest(*parts: Column) -> Column:
    """32 hex digits of SHA-256 over the parts joined by ``|``; null counts as empty, which ``concat_ws`` alone would drop."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def node_uid(trace_id: Column) -> Column:
    return F.concat(F.lit("n_"), digest(trace_id))


def edge_uid(from_uid: Column, predicate: Column, to_uid: Column, kind: Column, path: Column, line: Column) -> Column:
    return F.concat(F.lit("e_"), digest(from_uid, predicate, to_uid, kind, path, line))


def diagnostic_uid(rule: Column, trace_id: Column, path: Column, line: Column, message: Column) -> Column:
    return F.concat(F.lit("d_"), digest(rule, trace_id, path, line, message))


def valid_id(trace_id: Column) -> Column:
    return trace_id.rlike(ID_PATTERN)


def type_of(trace_id: Column) -> Column:
    """Node type by the id's prefix; null where none fits."""
    out = None
    for prefix, kind in TYPE_PREFIXES:
        fits = trace_id.startswith(prefix)
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out


def slug(text: Column) -> Column:
    """Lower case, runs of other than letters and digits to one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def fresh_ids(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """``base`` of each row of ``wanted`` (base, pos) made unique: the base itself where free, else ``base-2``, ``base-3``, ...

    ``taken``: trace_id.  Numbers go on after the largest one in use.
    """
    used = taken.select(F.regexp_replace("trace_id", r"-\d+$", "").alias("base"), F.coalesce(F.regexp_extract("trace_id", r"-(\d+)$", 1).try_cast("int"), F.lit(1)).alias("n"))
    used = used.unionByName(taken.select(F.col("trace_id").alias("base"), F.lit(1).alias("n"))).groupBy("base").agg(F.max("n").alias("last"))
    turn = F.row_number().over(Window.partitionBy("base").orderBy("pos"))
    n = F.coalesce("last", F.lit(0)) + turn
    return wanted.join(used, "base", "left").select("base", "pos", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string"))).alias("trace_id"))

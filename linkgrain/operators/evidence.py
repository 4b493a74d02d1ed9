"""Evidence: latest outcomes, proof levels, currency, ingestion of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import kept
from .rules import latest_run, proof_levels  # noqa: F401
from .structure import BUCKET, _buckets, covered_lines

#: Lines whose coverage is one whole number.
CELL = 64


def latest_outcomes(results: DataFrame, runs: DataFrame) -> DataFrame:
    """(fid, outcome, run_id) by the latest ``coalesce(started_at, run_id)`` as text, then run id.

    A run without a start thus counts as later than any with one.
    """
    rows = results.join(runs.select("run_id", "started_at"), "run_id", "left")
    key = F.struct(F.coalesce("started_at", "run_id"), F.col("run_id"))
    return rows.groupBy("fid").agg(F.max_by(F.struct("outcome", "run_id"), key).alias("m")).select("fid", "m.outcome", "m.run_id")


def run_status(results: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """fail for a run with a failed or broken test; a status that the report states itself counts instead."""
    own = results.groupBy("run_id").agg(F.when(F.bool_or(F.col("outcome").isin("fail", "error")), "fail").otherwise("pass").alias("own"))
    if given is None:
        return own.select("run_id", F.col("own").alias("status"))
    return own.join(given.select("run_id", "status"), "run_id", "full_outer").select("run_id", F.coalesce("status", "own").alias("status"))


def hit_counts(executions: DataFrame) -> DataFrame:
    return executions.groupBy("test", "impl").agg(F.count(F.lit(1)).alias("records"), F.sum("hits").alias("hits"))


def currency(nodes: DataFrame, bindings: DataFrame, runs: DataFrame, revision: str | None) -> DataFrame:
    """Why each node's evidence is current or not.

    ``nodes``: trace_id, fingerprint; ``bindings``: trace_id, run_id, fingerprint.
    """
    rows = nodes.select("trace_id", F.col("fingerprint").alias("now")).join(bindings, "trace_id", "left").join(runs.select("run_id", "revision"), "run_id", "left")
    bound, right = F.col("revision").isNotNull(), F.lit(True) if revision is None else F.col("revision") == revision
    per = rows.groupBy("trace_id").agg(
        F.count("run_id").alias("n"), F.coalesce(F.bool_or(bound), F.lit(False)).alias("bound"), F.coalesce(F.bool_or(bound & right), F.lit(False)).alias("right"), F.coalesce(F.bool_or(bound & right & (F.col("fingerprint") == F.col("now"))), F.lit(False)).alias("same")
    )
    reason = F.when(F.col("n") == 0, "no-evidence").when(~F.col("bound"), "missing-revision").when(~F.col("right"), "revision-mismatch").when(~F.col("same"), "fingerprint-mismatch").otherwise("current")
    return per.select("trace_id", reason.alias("reason"))


def coverage_edges(hit_lines: DataFrame, implementations: DataFrame) -> DataFrame:
    """Suite evidence (impl, hits) from covered lines (path, line) in implementation spans (path, id, s, e)."""
    return covered_lines(hit_lines, implementations).select(F.col("id").alias("impl"), F.col("lines").alias("hits"))


def per_test_edges(contexts: DataFrame, implementations: DataFrame) -> DataFrame:
    """Per-test evidence (test, impl, hits) from (test, path, line) in implementation spans."""
    covered = implementations.select("path", "id", "s", "e", _buckets(F.col("s"), F.col("e")).alias("b"))
    at = contexts.select("test", "path", "line", F.floor(F.col("line") / BUCKET).cast("int").alias("b"))
    hit = at.join(covered, ["path", "b"]).filter("line between s and e")
    return hit.groupBy("test", F.col("id").alias("impl")).agg(F.count(F.lit(1)).alias("hits"))


def linked_tests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(impl, test): the tests that verify a requirement which an implementation satisfies, or that exercise it; those that are nodes.

    A pair can only come again where implementation and test both have several
    requirements; only those pairs are gathered, the others go out as they meet.
    A pair that exercises is asked by its ends' requirements whether it met.
    """
    own = nodes.filter("node_type = 'implementation'").select(F.col("trace_id").alias("impl"))
    there = nodes.select(F.col("trace_id").alias("test"))
    reqs = edges.filter("p = 'satisfies' and t is not null").select(F.col("f").alias("impl"), F.col("t").alias("req")).join(own, "impl", "left_semi").groupBy("impl").agg(F.collect_set("req").alias("reqs"))
    verify = edges.filter("p = 'verifies' and t is not null").select(F.col("f").alias("test"), F.col("t").alias("req")).join(there, "test", "left_semi").groupBy("test").agg(F.collect_set("req").alias("verified"))
    reqs, verify = kept(reqs, "satisfied"), kept(verify, "verified")
    each = lambda rows, key, of: rows.select(key, F.explode(of).alias("req"), (F.size(of) > 1).alias(f"{key}_many"))
    met = each(reqs, "impl", "reqs").join(each(verify, "test", "verified"), "req")
    again = F.col("impl_many") & F.col("test_many")
    exercises = edges.filter("p = 'exercises'").select(F.col("t").alias("impl"), F.col("f").alias("test")).distinct().join(own, "impl", "left_semi").join(there, "test", "left_semi")
    exercises = exercises.join(reqs, "impl", "left").join(verify, "test", "left").filter(~F.coalesce(F.arrays_overlap("reqs", "verified"), F.lit(False)))
    return met.filter(~again).select("impl", "test").unionByName(met.filter(again).select("impl", "test").distinct()).unionByName(exercises.select("impl", "test"))


def context_lines(bits: DataFrame) -> DataFrame:
    """(test, path, s, e) from coverage contexts (context, path, numbits): runs of the lines whose bits are set, lowest bit of the first byte line 0.

    A context names its test before ``|``, which parts off the phase; an empty
    context is no test's.  Bits become runs within each row, so no line is a row.
    """
    test = F.nullif(F.split_part("context", F.lit("|"), F.lit(1)), F.lit(""))
    rows = bits.select(test.alias("test"), "path", F.hex("numbits").alias("h")).filter("test is not null and h <> ''")
    rows = rows.withColumn("bytes", F.transform(F.sequence(F.lit(0), (F.length("h") / 2).cast("int") - 1), lambda i: F.conv(F.substring(F.col("h"), 2 * i + 1, F.lit(2)), 16, 10).cast("int")))
    set_ = F.flatten(F.transform("bytes", lambda b, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(b.cast("long"), k) == 1), lambda k: i * 8 + k)))
    rows = rows.select("test", "path", set_.alias("lines")).filter(F.size("lines") > 0)
    starts = F.filter(F.col("lines"), lambda x, i: (i == 0) | (F.element_at(F.col("lines"), F.greatest(i, F.lit(1))) != x - 1))
    ends = F.filter(F.col("lines"), lambda x, i: (i + 1 == F.size("lines")) | (F.element_at(F.col("lines"), F.least(i + 2, F.size("lines"))) != x + 1))
    return rows.select("test", "path", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("r")).select("test", "path", F.col("r.s").alias("s"), F.col("r.e").alias("e"))


def context_edges(runs: DataFrame, implementations: DataFrame) -> DataFrame:
    """Per-test evidence (test, impl, hits): the lines of each test's runs (test, path, s, e) that lie in implementation spans (path, id, s, e), each line once.

    Lines are bits of cells of 64.  A test's cells of a path stay together in
    each of its rows, so that a pair is counted whole where it first meets and no
    pair is gathered; only implementations with several spans are.
    """
    held = runs.filter("s <= e").select("test", "path", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / CELL), F.floor(F.col("e") / CELL))).alias("cell"))
    held = held.groupBy("test", "path", "cell").agg(F.bit_or(_bits(F.col("s"), F.col("e"), F.col("cell"))).alias("bits"))
    cells = held.groupBy("test", "path").agg(F.collect_list(F.struct("cell", "bits")).alias("cells"))
    at = cells.select("test", "path", "cells", F.inline("cells"))
    spans = implementations.filter("s <= e").groupBy("id").agg(F.collect_list(F.struct("path", "s", "e")).alias("spans"))
    spans = spans.select("id", (F.size("spans") > 1).alias("several"), F.inline("spans"))
    spans = spans.groupBy("path", "s", "e", "several").agg(F.collect_list("id").alias("ids"))
    covered = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("s") / CELL), F.floor(F.col("e") / CELL))))
    hit = at.join(covered, ["path", "cell"])
    hit = hit.filter(F.col("bits").bitwiseAND(_bits(F.col("s"), F.col("e"), F.col("cell"))) != 0)
    shared = lambda c: F.bit_count(c["bits"].bitwiseAND(_bits(F.col("s"), F.col("e"), c["cell"]))).cast("long")
    wide = (F.size("cells") > 1) & (F.floor(F.col("s") / CELL) < F.floor(F.col("e") / CELL))
    own = F.bit_count(F.col("bits").bitwiseAND(_bits(F.col("s"), F.col("e"), F.col("cell")))).cast("long")
    within = F.filter("cells", lambda c: (c["cell"] >= F.floor(F.col("s") / CELL)) & (c["cell"] <= F.floor(F.col("e") / CELL)) & (shared(c) > 0))
    first = ~wide | ~F.exists(within, lambda c: c["cell"] < F.col("cell"))
    hits = F.when(wide, F.aggregate(within, F.lit(0).cast("long"), lambda n, c: n + shared(c))).otherwise(own)
    rows = hit.filter(first).select("test", "ids", "several", hits.alias("hits"))
    each = lambda x: x.select("test", F.explode("ids").alias("impl"), "hits")
    return each(rows.filter("not several")).unionByName(each(rows.filter("several")).groupBy("test", "impl").agg(F.sum("hits").alias("hits")))


def _bits(start: Column, end: Column, cell: Column) -> Column:
    """The lines ``start`` to ``end`` of a cell as bits; all bits if they go beyond it on both sides."""
    low, high = F.greatest(start - cell * CELL, F.lit(0)), F.least(end - cell * CELL, F.lit(CELL - 1))
    return F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (CELL - 1 - (high - low)).cast("int")), low.cast("int"))


def verification_rows(nodes: DataFrame, edges: DataFrame, outcomes: DataFrame, executions: DataFrame) -> DataFrame:
    """Per implementation and exercising test: latest outcome, proof level, whether it is current."""
    pairs = edges.filter("p = 'exercises'").select(F.col("f").alias("test"), F.col("t").alias("impl"))
    levels = proof_levels(pairs, executions)
    own = outcomes.select(F.col("fid").alias("test"), "outcome")
    rows = levels.join(own, "test", "left").join(nodes.select(F.col("trace_id").alias("impl"), "status"), "impl")
    return rows.select("impl", "test", "level", "outcome", F.coalesce((F.col("outcome") == "pass") & (F.col("status") == "current"), F.lit(False)).alias("current"))


def ingested(reports: DataFrame, tests: DataFrame, runs: DataFrame, results: DataFrame, executions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, results, executions) after the normalised ``reports`` (of ``readers.read_evidence``) came in.

    A report replaces what its run had.  ``tests``: trace_id and
    framework_test_id, which bind results to nodes; a result that names a node
    itself is bound to that.  A status that the report states counts.
    """
    from .change import upsert

    new_runs = reports.select("run_id", "revision", "provider", "started_at", "completed_at", "status").dropDuplicates(["run_id"])
    rows = reports.select("run_id", F.explode("tests").alias("x")).select("run_id", F.col("x.framework_id").alias("fid"), "x.outcome", "x.duration_ms", F.col("x.trace_id").alias("named"))
    known = tests.select(F.col("framework_test_id").alias("fid"), F.col("trace_id").alias("bound")).groupBy("fid").agg(F.min("bound").alias("bound"))
    rows = rows.join(known, "fid", "left").select("run_id", "fid", F.coalesce("named", "bound").alias("test"), "outcome", "duration_ms")
    rows = rows.groupBy("run_id", "fid").agg(F.max_by(F.struct("test", "outcome", "duration_ms"), F.struct("outcome", "duration_ms")).alias("r")).select("run_id", "fid", "r.*")
    edges = reports.select("run_id", F.explode("execution_edges").alias("x")).select("run_id", F.col("x.test_uid").alias("test"), F.col("x.implementation_uid").alias("impl"), F.col("x.coverage_kind").alias("kind"), F.col("x.hit_count").alias("hits")).distinct()
    rest = lambda old: old.join(new_runs.select("run_id"), "run_id", "left_anti")
    return upsert(runs, new_runs.select(runs.columns), ["run_id"]), rest(results).unionByName(rows.select(results.columns)), rest(executions).unionByName(edges.select(executions.columns))

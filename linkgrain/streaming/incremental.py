"""Incremental indexing as streams: new files to markers, evidence without repeats, obligations by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.extract import declared_edges, marker_lines


def index_stream(files: DataFrame, target: str, checkpoint: str):
    """Keeps appending the declared edges of a stream of (path, text) to the Parquet table ``target``, with the batch they came in.

    ``current_edges`` gives the last state of every path, so that replaying a
    batch after a failure changes nothing.
    """

    def batch(rows: DataFrame, number: int) -> None:
        found = declared_edges(marker_lines(rows))
        seen = rows.select("path", F.lit(None).cast("int").alias("line"), *[F.lit(None).cast("string").alias(c) for c in ("f", "p", "t")])
        found.unionByName(seen.distinct()).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(lambda rows, n: batch(rows, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_edges(spark, target: str) -> DataFrame:
    """Edges of each path from the last batch that saw the path."""
    rows = spark.read.parquet(target)
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"], "left_semi").filter("f is not null").select("path", "line", "f", "p", "t")


def evidence_once(results: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of results (run_id, framework_test_id, outcome, at) without deliveries of the same result again within the delay."""
    return results.withWatermark("at", delay).dropDuplicatesWithinWatermark(["run_id", "framework_test_id"])


def outcome_windows(results: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Outcomes counted by window of event time; rows later than the delay are left out."""
    return results.withWatermark("at", delay).groupBy(F.window("at", size), "outcome").agg(F.count(F.lit(1)).alias("n"))


def obligations(events: DataFrame, delay: str = "1 hour", idle_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """State of each (path, symbol) from a stream of (path, symbol, traced): pending until a traced event satisfies it.

    Where the events have a time ``at``, a symbol without an event for
    ``idle_ms`` of event time is forgotten, so the state is bounded by the
    symbols in use.
    """
    timed = "at" in events.columns

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, seen = state.get if state.exists else (False, 0)
        last = 0
        for frame in frames:
            done = done or bool(frame["traced"].any())
            seen += len(frame)
            last = max(last, int(frame["at"].max().timestamp() * 1000)) if timed else last
        state.update((done, seen))
        if timed:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"path": [key[0]], "symbol": [key[1]], "state": ["satisfied" if done else "pending"], "events": [seen]})

    rows = events.withWatermark("at", delay) if timed else events
    ends = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy("path", "symbol").applyInPandasWithState(step, "path string, symbol string, state string, events long", "done boolean, seen long", "update", ends)


def ledger(events: DataFrame) -> DataFrame:
    """The same states over a finished table of (path, symbol, traced, at)."""
    return events.groupBy("path", "symbol").agg(F.when(F.bool_or("traced"), "satisfied").otherwise("pending").alias("state"), F.count(F.lit(1)).alias("events"))


__all__ = ["current_edges", "evidence_once", "index_stream", "ledger", "obligations", "outcome_windows"]

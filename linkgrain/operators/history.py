"""Change history: commits of a path under all its names.

Commits: path, sha, author, date, summary, seq (larger is newer), old_path (the
name before, where the commit renamed the file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept


def names(paths: DataFrame, commits: DataFrame) -> DataFrame:
    """(path, name) for each asked path: itself and all names it was renamed from.

    ``moves`` lead over 1, 2, 4, ... renames and ``known`` holds the names over
    fewer, so a chain of n renames takes about log2(n) rounds.
    """
    moves = kept(commits.filter("old_path is not null").select(F.col("path").alias("name"), F.col("old_path").alias("older")).distinct(), "moves")
    known = kept(paths.select("path", F.col("path").alias("name")).distinct(), "names")
    while True:
        older = known.join(moves, "name").select("path", F.col("older").alias("name"))
        more = kept(known.unionByName(older).distinct(), "names")
        if more.count() == known.count():
            return known
        known = more
        further = moves.select(F.col("name").alias("older"), F.col("older").alias("oldest"))
        moves = kept(moves.join(further, "older").select("name", F.col("oldest").alias("older")).distinct(), "moves")


def _under_all_names(paths: DataFrame, commits: DataFrame) -> DataFrame:
    return names(paths, commits).join(commits.select(F.col("path").alias("name"), "sha", "author", "date", "summary", "seq"), "name")


def _newest_first() -> list[Column]:
    return [F.desc("seq"), F.asc("sha"), F.asc("name")]


def file_history(paths: DataFrame, commits: DataFrame) -> DataFrame:
    """All commits of each path and its earlier names, newest first by ``rank``: path, name, sha, author, date, summary, rank.

    Commits are dealt by ranges of that order, ranked in their range, and moved
    on by the ranges before it, so that no path's history needs one task.
    """
    rows = _under_all_names(paths, commits).repartitionByRange("path", *_newest_first()).withColumn("part", F.spark_partition_id())
    rows = kept(rows, "history")
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("path", "part").agg(F.count(F.lit(1)).alias("n")).select("path", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("path", "part").orderBy(*_newest_first()))
    rows = rows.withColumn("own", own).join(ahead.hint("merge"), ["path", "part"])
    return rows.select("path", "name", "sha", "author", "date", "summary", (F.col("own") + F.col("ahead")).cast("int").alias("rank"))


def last_commits(paths: DataFrame, commits: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest rows of ``file_history`` for each path."""
    rows = _under_all_names(paths, commits).withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(*_newest_first()))).filter(F.col("rank") <= most)
    return rows.select("path", "name", "sha", "author", "date", "summary", "rank")


def old_paths(paths: DataFrame, commits: DataFrame) -> DataFrame:
    return names(paths, commits).filter("name <> path").withColumnRenamed("name", "old_path")


def commits_touching(paths: DataFrame, commits: DataFrame) -> DataFrame:
    """(sha, paths): commits of any of the paths, with how many of them each touched."""
    return commits.join(paths.select("path").distinct(), "path", "left_semi").groupBy("sha").agg(F.count_distinct("path").alias("paths"))


def ends(commits: DataFrame) -> DataFrame:
    """(path, first_seen, latest): the oldest and the newest commit of each path."""
    return commits.groupBy("path").agg(F.min_by("sha", F.struct("seq", "sha")).alias("first_seen"), F.max_by("sha", F.struct("seq", "sha")).alias("latest"))

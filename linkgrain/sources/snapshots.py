"""Versions of an index: all its tables in one folder, published together or not at all.

``root``/<version>/<name> holds a table; ``root``/published/<number> names the
version of that number.  A number is taken by a rename that does not overwrite,
which the file system decides once, so of two writers that started from the same
version one publishes and the other is told.  Readers take the largest number
and see that version whole, however many tables they read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Superseded(Exception):
    """Another version was published since the one that a writer started from."""


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop
    at = jvm.fs.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(number, version) of what is published; (0, None) before the first."""
    jvm, at, fs = _files(spark, f"{root}/published")
    if not fs.exists(at):
        return 0, None
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()]
    if not numbers:
        return 0, None
    number = max(numbers)
    return number, spark.read.text(f"{root}/published/{number:012d}").first()[0]


def publish(frames: dict[str, DataFrame], root: str, base: int, version: str | None = None) -> int:
    """Writes ``frames`` as a version after number ``base`` and gives its number; ``Superseded`` if that is not the current one any more.

    Tables are written before the number is taken, and frames may read the
    version before, which stays.
    """
    spark = next(iter(frames.values())).sparkSession
    version = version or uuid.uuid4().hex
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
    jvm, draft, fs = _files(spark, f"{root}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(f"{version}\n".encode()))
    out.close()
    _, folder, _ = _files(spark, f"{root}/published")
    fs.mkdirs(folder)
    none = spark._sc._gateway.new_array(jvm.fs.Options.Rename, 0)
    try:
        if current(spark, root)[0] != base:
            raise Superseded(f"{root}: number {base} is not the current one")
        jvm.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, jvm.fs.Path(folder, f"{base + 1:012d}"), none)
    except Exception as e:
        fs.delete(draft, False)
        if isinstance(e, Superseded) or "FileAlreadyExists" in str(e):
            raise Superseded(f"{root}: number {base + 1} is taken") from e
        raise
    return base + 1


def read(spark: SparkSession, root: str, *names: str) -> tuple[DataFrame, ...]:
    """Tables of one and the same published version."""
    _, version = current(spark, root)
    if version is None:
        raise FileNotFoundError(f"{root}: nothing is published")
    return tuple(spark.read.parquet(f"{root}/{version}/{name}") for name in names)


def updated(spark: SparkSession, root: str, names: tuple[str, ...], change, attempts: int = 5) -> int:
    """Publishes ``change`` of the current tables (name to frame, empty before the first); where another writer was faster, of what that one published."""
    for _ in range(attempts):
        base, version = current(spark, root)
        tables = {} if version is None else {n: spark.read.parquet(f"{root}/{version}/{n}") for n in names}
        try:
            return publish(change(tables), root, base)
        except Superseded:
            continue
    raise Superseded(f"{root}: {attempts} attempts were each overtaken")

"""Readers of repository text and evidence reports, each a Spark source with a fixed schema."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import ID_PATTERN
from ..functions.text import any_glob
from ..operators.structure import coalesced
from . import snapshots

MAX_FILE, MAX_REPORT = 2 << 20, 10 << 20
ALWAYS_IGNORED = (".git/**", "**/__pycache__/**", "**/.pytest_cache/**", "**/node_modules/**")
# Kind and language by extension.
EXTENSIONS = {
    "py": ("source", "python"), "pyi": ("source", "python"),
    "ts": ("source", "typescript"), "tsx": ("source", "typescript"), "mts": ("source", "typescript"), "cts": ("source", "typescript"),
    "js": ("source", "javascript"), "jsx": ("source", "javascript"), "mjs": ("source", "javascript"), "cjs": ("source", "javascript"),
    "go": ("source", "go"), "rs": ("source", "rust"), "java": ("source", "java"),
    "c": ("source", "c"), "h": ("source", "c"), "cpp": ("source", "cpp"), "cc": ("source", "cpp"), "cxx": ("source", "cpp"), "hpp": ("source", "cpp"),
    "sh": ("source", "shell"), "bash": ("source", "shell"), "zsh": ("source", "shell"), "sql": ("source", "sql"),
    "yaml": ("config", "yaml"), "yml": ("config", "yaml"), "json": ("config", "json"), "toml": ("config", "toml"),
    "md": ("doc", "markdown"), "markdown": ("doc", "markdown"), "rst": ("doc", "text"), "txt": ("doc", "text"),
    "csv": ("data", "text"), "tsv": ("data", "text"), "jsonl": ("data", "json"),
}


def classified(path: Column) -> tuple[Column, Column]:
    """(kind, language) by the extension; (``other``, null) where it is not known."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for e, (k, n) in EXTENSIONS.items() for x in (e, f"{k}|{n}")])
    found = F.try_element_at(known, ext)
    return F.coalesce(F.split_part(found, F.lit("|"), F.lit(1)), F.lit("other")), F.nullif(F.split_part(F.coalesce(found, F.lit("|")), F.lit("|"), F.lit(2)), F.lit(""))


def scan_files(spark: SparkSession, root: str, *, include=("**",), exclude=(), generated=(), ignored: DataFrame | None = None, most: int = MAX_FILE) -> DataFrame:
    """path, kind, language, size, generated, text of the files below ``root`` that the globs let in; files over ``most`` bytes, not in UTF-8, or whose path is in ``ignored`` (path) are left out.

    Name and size filters run on the listing's metadata, before contents are decoded.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    rows = raw.withColumn("rel", F.expr(f"substring(path, locate('{base}', path) + {len(base)})")).filter(F.col("length") <= most)
    rows = rows.filter(any_glob(F.col("rel"), include) & ~any_glob(F.col("rel"), (*ALWAYS_IGNORED, *exclude)))
    rows = rows if ignored is None else rows.join(ignored.select(F.col("path").alias("rel")).distinct(), "rel", "left_anti")
    text = F.expr("try_validate_utf8(cast(content as string))")
    kind, language = classified(F.col("rel"))
    return rows.select(F.col("rel").alias("path"), kind.alias("kind"), language.alias("language"), F.col("length").alias("size"), any_glob(F.col("rel"), generated).alias("generated"), text.alias("text")).filter("text is not null")


def with_scope(files: DataFrame, scopes: dict[str, list[str]]) -> DataFrame:
    """The scope whose literal prefix is the longest, ties to the first name."""
    best = F.array(*[F.struct(F.lit(len(p.rstrip("/"))).alias("n"), F.lit(name).alias("name"), F.lit(p.rstrip("/")).alias("p")) for name, ps in sorted(scopes.items()) for p in ps])
    fits = F.filter(best, lambda x: (F.col("path") == x["p"]) | F.col("path").startswith(F.concat(x["p"], F.lit("/"))))
    first = F.array_sort(fits, lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return files.withColumn("scope", F.get(first, F.lit(0))["name"])


_TEXT = "struct<_VALUE: string, _message: string>"
JUNIT = f"_classname string, _name string, _time string, failure {_TEXT}, error {_TEXT}, skipped {_TEXT}"


def junit_results(cases: DataFrame) -> DataFrame:
    """framework_test_id, outcome, duration_ms of parsed ``testcase`` elements."""
    name = F.when(F.coalesce("_classname", F.lit("")) != "", F.concat("_classname", F.lit("."), "_name")).otherwise(F.col("_name"))
    outcome = F.when(F.col("failure").isNotNull(), "fail").when(F.col("error").isNotNull(), "error").when(F.col("skipped").isNotNull(), "skip").otherwise("pass")
    return cases.select(name.alias("framework_test_id"), outcome.alias("outcome"), (F.col("_time").try_cast("double") * 1000).alias("duration_ms"))


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    return junit_results(spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\0").schema(JUNIT).load(path))


COBERTURA = "_filename string, lines struct<line: array<struct<_number: int, _hits: bigint>>>, methods struct<method: array<struct<lines: struct<line: array<struct<_number: int, _hits: bigint>>>>>>"


def read_cobertura(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of covered lines; those of methods count too. Of several classes of one file in a report the last counts."""
    rows = spark.read.format("xml").option("rowTag", "class").schema(COBERTURA).load(path)
    nothing = F.expr("cast(array() as array<struct<_number: int, _hits: bigint>>)")
    inner = F.flatten(F.transform(F.coalesce("methods.method", F.expr("cast(array() as array<struct<lines: struct<line: array<struct<_number: int, _hits: bigint>>>>>)")), lambda m: F.coalesce(m["lines"]["line"], nothing)))
    lines = F.concat(F.coalesce("lines.line", nothing), inner)
    # A report is read in order by one task, so later classes have larger numbers.
    classes = rows.select(F.col("_filename").alias("path"), lines.alias("lines"), F.monotonically_increasing_id().alias("n"), F.col("_metadata.file_path").alias("report"))
    last = classes.groupBy("report", "path").agg(F.max_by("lines", "n").alias("lines"))
    return last.select("path", F.explode(F.filter("lines", lambda x: x["_hits"] > 0)).alias("x")).select("path", F.col("x._number").alias("line")).distinct()


EVIDENCE = ("schema string, run_id string, status string, revision string, provider string, started_at string, completed_at string, "
    "tests array<struct<framework_id: string, outcome: string, duration_ms: double, trace_id: string>>, "
    "execution_edges array<struct<test_uid: string, implementation_uid: string, coverage_kind: string, hit_count: bigint>>"
)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Normalised evidence reports; a report with any invalid row is left out whole."""
    rows = spark.read.schema(EVIDENCE).option("multiLine", "true").json(path)
    good = F.col("run_id").isNotNull() & F.col("status").isin("pass", "fail")
    good = good & F.coalesce(F.forall("tests", lambda t: t["framework_id"].isNotNull() & t["outcome"].isin("pass", "fail", "skip", "error")), F.lit(True))
    good = good & F.coalesce(F.forall("execution_edges", lambda e: e["test_uid"].isNotNull() & e["implementation_uid"].isNotNull() & e["coverage_kind"].isin("suite", "per_test")), F.lit(True))
    return rows.filter(F.coalesce(good, F.lit(False)))


RECEIPTS = "work string, operation string, path string, targets array<string>, before string, after string, session string, commit string"


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECEIPTS).option("mode", "DROPMALFORMED").json(path)


def work_paths(receipts: DataFrame) -> DataFrame:
    return receipts.filter("work is not null and path is not null").groupBy("work").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def diff_ranges(diff: DataFrame) -> DataFrame:
    """(path, s, e) of the new side of hunk headers, adjacent ones as one; pure deletions have none. ``diff``: path, text."""
    spans = diff.select("path", F.explode(F.split("text", "\n")).alias("l")).filter(F.col("l").startswith("@@"))
    start = F.regexp_extract("l", r"\+(\d+)", 1).cast("int")
    n = F.coalesce(F.nullif(F.regexp_extract("l", r"\+\d+,(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    return coalesced(spans.select("path", start.alias("s"), (start + n - 1).alias("e"), n.alias("n")).filter("n > 0").drop("n"))


def write_snapshot(frames: dict[str, DataFrame], root: str, version: str) -> None:
    """Publishes ``frames`` as a new version: readers see the old one or the new one whole."""
    spark = next(iter(frames.values())).sparkSession
    snapshots.publish(frames, root, snapshots.current(spark, root)[0], version)


def read_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the version that was published last."""
    return snapshots.read(spark, root, name)[0]


def work_items(files: DataFrame) -> DataFrame:
    """Work items that TOML files (path, text) declare as ``[work."ID"]``: path, trace_id, title, mirrors (JSON), problem (TL100) or null."""

    def run(frames):
        for frame in frames:
            rows = []
            for path, text in frame[["path", "text"]].itertuples(index=False):
                try:
                    made = tomllib.loads(text or "").get("work", {})
                except tomllib.TOMLDecodeError as e:
                    rows.append((path, None, None, None, f"not TOML: {e}"))
                    continue
                for key, entry in made.items() if isinstance(made, dict) else ():
                    if isinstance(entry, dict):
                        title, mirrors = entry.get("title"), entry.get("mirrors")
                        bad = None if re.match(ID_PATTERN, key) else "invalid id"
                        rows.append((path, key, title if isinstance(title, str) else None, json.dumps(mirrors if isinstance(mirrors, dict) else {}, default=str), bad))
            yield pd.DataFrame(rows, columns=["path", "trace_id", "title", "mirrors", "problem"])

    return files.select("path", "text").mapInPandas(run, "path string, trace_id string, title string, mirrors string, problem string")


SIDECAR = "entries array<struct<line: int, key: string, marker: string>>"


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """(path, key, line, marker) of the entries in sidecar files ``root``/<path>.json; files that do not parse have none."""
    raw = spark.read.schema(SIDECAR).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    base = root.rstrip("/") + "/"
    rows = raw.withColumn("file", F.col("_metadata.file_path")).withColumn("path", F.expr(f"substring(file, locate('{base}', file) + {len(base)})"))
    rows = rows.select(F.regexp_replace("path", r"\.json$", "").alias("path"), F.explode("entries").alias("x"))
    return rows.select("path", "x.key", "x.line", "x.marker")

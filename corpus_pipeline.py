"""A training corpus from ``documents``: five stages, each over all rows that the one before it kept.

Each function takes (spark, docs, sf_dir); all but the last return the columns
of ``documents``.  An empty table passes every stage as an empty table, columns
of any other names pass the first four, and repeated rows become one row in the
second.  Each stage's docstring says what nulls, ties and repeated ids give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkgrain.llm import decontaminate, language, mix, near, suffix
from linkgrain.llm.common import unused_name, written

#: A document without a language of at least this share is rejected.
LEAST_SHARE = 0.4


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: null, empty or letterless texts, and those where no learned language has LEAST_SHARE.

    Rows without an id go too, as no later stage could name them.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    return language.accepted(named, language.fold_model(named), LEAST_SHARE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id; texts without words have no group.

    Of rows with one id the one with the smallest text stays (null first; ties
    go by the other columns), so repeated rows become one.
    """
    kept = near.near_duplicates(docs, words=5).filter("kept")
    # The join leaves the rows dealt by id, so the window moves none.
    rows = _semi(docs, kept).select("*", F.row_number().over(Window.partitionBy("doc_id").orderBy("text", *[F.col(f"`{c}`") for c in sorted(set(docs.columns) - {"doc_id", "text"})])).alias(place := unused_name("row", docs.columns)))
    return rows.filter(F.col(place) == 1).select(*_all(docs))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 or more words that stand in an earlier place too; a document goes if no word is left of it. Counts n_chars anew.

    Earlier goes by id, then by text hash and place.  Null texts stay, texts of
    fewer words have no passage, texts without a word go; repeated rows are cut
    alike.
    """
    passages = written(suffix.repeated_passages(docs), "passages")
    rest = suffix.without_passages(docs, passages)
    rest = rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rest.filter(F.col("text").isNull() | F.col("text").rlike(mix.WORD)).select(*_all(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    All rows of such a document's id go; null and empty texts hold none, and an
    empty benchmark drops nothing.
    """
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(written(found.select("doc_id").distinct(), "contaminated"), "doc_id", "left_anti").select(*_all(docs))


def mix_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes: shard, position, doc_id, source, lang, epoch, words, text (cut after ``words`` words where the target ends).

    A null source is one of its own; null and empty texts take no words and give
    no row; ties in a shard's order go by id and epoch; repeated ids would give
    each copy every text of theirs, so the stages before leave one row an id.
    """
    plan = written(mix.mix_sources(docs), "mix-plan")
    # One plan at every size: the copies grow with the documents.
    rows = mix.mixed_rows(plan).drop("source").join(docs.select("doc_id", "source", "lang", "text").hint("merge"), "doc_id")
    pieces = F.split("text", "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    text = F.when(F.col("words") < F.regexp_count("text", F.lit(mix.WORD)), F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select("shard", "position", "doc_id", "source", "lang", "epoch", "words", "text")


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _semi(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return docs.join(written(kept.select("doc_id").distinct(), "kept").hint("merge"), "doc_id", "left_semi").select(*_all(docs))


STAGES = [
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mix", mix_shards),
]

#: The stages' models and sketches are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

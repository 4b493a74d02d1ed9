"""Operator 12: document fingerprints, DataFrame functions only.

A threshold-scaled sketch: of a text's shingles every one whose hash lies below
a fixed fraction of the hash space is retained.  What is retained depends on the
shingle alone, so sketches of parts unite to the sketch of the whole, and the
part of a small text's sketch that stands in a large one's estimates how much of
it the large one contains, whatever their sizes.

A shingle ends at each word and holds it with up to four words before; only the
first four of a text are shorter.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
lower-cased, hashes 48 bits of MD5, which any engine gives alike.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mix import WORD, _let

WORDS = 5
#: Hex digits kept of a hash, and those below which a hash is retained: a quarter.
DIGITS = 12
LIMIT = "4" + "0" * (DIGITS - 1)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most ids that may go to the driver as bounds of ranges.
MOST_RANGES = 1 << 14


def sketch(text: Column, words: int = WORDS, limit: str = LIMIT) -> Column:
    """The retained hashes of a text, sorted hex strings of DIGITS digits; empty without words (or null).

    A text none of whose hashes is below the limit retains its smallest one.
    """

    def hashes(p: Column) -> Column:
        ends = F.when(F.size(p["w"]) > 0, F.sequence(F.lit(1), F.size(p["w"]))).otherwise(F.expr("cast(array() as array<int>)"))
        shingle = lambda i: F.array_join(F.slice(p["w"], F.greatest(F.lit(1), i - (words - 1)), F.least(i, F.lit(words))), " ")
        return _let(retained, h=F.transform(ends, lambda i: F.substring(F.md5(shingle(i)), 1, DIGITS)))

    def retained(q: Column) -> Column:
        below = F.filter(q["h"], lambda h: h < limit)
        return F.when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).when(F.size(q["h"]) > 0, F.array(F.array_min(q["h"]))).otherwise(below)

    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return _let(hashes, w=F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)))


def merged(a: Column, b: Column, limit: str = LIMIT) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda h: h < limit)
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, F.lit(1), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of two sketched texts, 0 to 1; two empty sketches are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second holds, 0 to 1; all of none."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def with_next(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = 500) -> DataFrame:
    """(_id, _text, _next): each row's text and that of the next row by falling id, after the last the first.

    Rows go once through a shuffle, dealt by ranges of ids whose bounds are ids
    themselves; the row of a bound also goes to the range before, where it is
    the next of the last.  Bounds are all ids whose hash is below a share that
    gives about eight a range, thinned to one; they decide where rows go, never
    the result.  Nulls come last; ties go by falling text hash for null ids,
    then by rising text.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_id").isNull()).alias("nulls")).first()
    # Rows without an id are told apart by their text; where all have one, no text is read for the bounds.
    tie = F.when(F.col("_id").isNull(), F.xxhash64("_text")).otherwise(F.lit(0).cast("long")) if known["nulls"] else F.lit(0).cast("long")
    rows = rows.withColumn("_key", F.struct(F.col("_id").alias("i"), tie.alias("h")))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(MOST_RANGES, max(4 * partitions, known["n"] // rows_per_range), known["n"]))
    every = max(1, known["n"] // (8 * ranges))
    keys = rows.select("_key")
    drawn = keys.filter(F.pmod(F.xxhash64("_key"), F.lit(every)) == 0).distinct()
    top = keys.agg(F.max("_key").alias("k")).first()["k"]
    falling = sorted({tuple(r["_key"]) for r in drawn.collect()}, key=lambda k: ((k[0] is not None), k[0] if k[0] is not None else 0, k[1]), reverse=True)  # about 8 a range: at most 131,072
    bounds = falling[:: max(1, len(falling) // ranges)]
    if top is not None and bounds[:1] != [tuple(top)]:
        bounds.insert(0, tuple(top))
    kind = docs.schema[id_col].dataType.simpleString()
    known_bounds = F.from_json(F.lit(json.dumps([{"i": i, "h": h} for i, h in bounds], default=str)), f"array<struct<i:{kind},h:bigint>>")
    return _nexts(rows, known_bounds, len(bounds))


def _nexts(rows: DataFrame, bounds: Column, n: int) -> DataFrame:
    """``with_next`` given the ranges' first keys, falling."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        down = F.element_at(bounds, F.least(middle + 1, F.lit(max(1, n)))) >= F.col("_key")
        return F.when(at["lo"] >= at["hi"], at).when(down, F.struct((middle + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), middle.alias("hi")))

    steps = F.sequence(F.lit(0), F.lit(max(1, n).bit_length()))
    # How many bounds are not below the key, less one: the range that the row is in.
    own = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve, lambda at: at["lo"] - 1)
    places = F.when(
        F.element_at(bounds, F.col("_range") + 1) == F.col("_key"),
        F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("tail")), F.struct(F.pmod(F.col("_range") - 1, F.lit(max(1, n))).alias("r"), F.lit(True).alias("tail"))),
    ).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(False).alias("tail"))))
    dealt = rows.withColumn("_range", own).withColumn("_place", F.explode(places)).select("_id", "_text", "_key", "_place.r", "_place.tail")
    order = Window.partitionBy("r").orderBy("tail", F.desc("_key"), "_text")
    return dealt.withColumn("_next", F.lead("_text").over(order)).filter("not tail").select("_id", "_text", "_next")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, limit: str = LIMIT) -> DataFrame:
    """A row per input row: id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch.

    The edited text has the last third of the text's code points (rounded down)
    replaced by the first as many of the next text by falling id (all of it, if
    shorter); after the last row comes the first.

    Defined results: a null text is an empty one; an empty text, or one without
    words, has an empty sketch, and two empty sketches are alike; repeated rows
    are next to each other, ties of one id going by the text; null ids come last,
    ordered among themselves by a hash of the text; one row alone is next to
    itself; an empty table gives an empty table; other columns are not read.  A
    text is worked on whole, at about 30 times its size in memory.  Rows that are
    equal in id and text share a range, so only equal rows can crowd one.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.length("_text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("_text", 1, n - third), F.substring("_next", 1, third))
    rows = rows.select("_id", n.cast("long").alias("n_chars"), "_text", "_next", edited.alias("_edited"))
    return rows.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        sketch(F.col("_text"), words, limit).alias("sketch"), sketch(F.col("_edited"), words, limit).alias("edited_sketch"), sketch(F.col("_next"), words, limit).alias("next_sketch"),
    )


def as_string(sketched: Column) -> Column:
    """A sketch as one string: its hashes one after the other."""
    return F.array_join(sketched, "")

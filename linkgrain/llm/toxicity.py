"""Operator 4: toxicity from two Kneser-Ney language models.

A toxic and an ordinary model give each letter of a word, and the word's end, a
probability after the letters before it in the word: grams of up to ORDER bytes.
Both are interpolated Kneser-Ney models: at the highest order a class has its own
counts c(h, w), c(h) and N1+(h .), discounted by DISCOUNT,

    P_c(w | h) = (max(c_c(h, w) - D, 0) + D N1+_c(h .) P(w | h')) / c_c(h),

and P(w | h'), the lower orders, is shared by the classes: continuation counts
N1+(. h' w) over both, down to a uniform distribution over bytes.  So an
expression that a class has seldom seen leans on counts that favour neither.

Counts are exact rows of Spark tables and grow with the labelled texts; what
scoring needs of them, log P_1 / P_0 of every seen gram and of every seen
context's backoff, is a table too.  A text is scored by log-likelihoods divided
by length: the mean log ratio of all its words, and of its worst stretches of 1,
4 and 16 words.  A logistic curve turns them into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, text_chunks, written
from .language import fold

#: Bytes of a gram, the one that is told included; at most 7, so that a gram is a long.
ORDER = 6
DISCOUNT = 0.75
WINDOWS = (1, 4, 16)
#: Labelled texts on which the log ratios are turned into a probability.
CALIBRATION_ROWS = 20_000
#: Rows of a model that tasks hold whole, 12 bytes each; a larger model meets the texts' grams in a join.
HELD_ROWS = 8_000_000
#: Distinct grams that a counting task holds before it gives them out.
COUNTED_GRAMS = 1_000_000
EDGE = 32
UNIT = 1 << 20
_FOLDED = np.full(256, EDGE, np.uint8)
for _a, _b, _to in ((65, 91, 97), (97, 123, 97), (128, 256, 128)):
    _FOLDED[_a:_b] = np.arange(_to, _to + _b - _a)


def letters(w) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words of letters, A-Z lower-cased, each followed by EDGE, and the number of words by text."""
    raw = _FOLDED[w.raw]
    text = np.repeat(np.arange(len(w), dtype=np.int32), np.diff(w.text_offsets))
    stream, text = np.insert(raw, w.text_offsets[1:], EDGE), np.insert(text, w.text_offsets[1:], np.arange(len(w)))
    keep = np.ones(len(stream), bool)
    keep[1:] = (stream[1:] != EDGE) | (stream[:-1] != EDGE)
    keep[:1] = stream[:1] != EDGE
    stream, text = stream[keep], text[keep]
    return stream, np.bincount(text[stream == EDGE], minlength=len(w))


def grams(stream: np.ndarray, order: int):
    """(word starts, grams) for pieces of whole words: each byte with up to ``order`` - 1 before it, to the EDGE before the word."""
    ends = np.flatnonzero(stream == EDGE) + 1
    at = 0
    while at < len(stream):
        to = int(ends[min(np.searchsorted(ends, at + CHUNK_BYTES), len(ends) - 1)])
        piece = stream[at:to]
        out, inside = piece.astype(np.int64), np.ones(len(piece), bool)
        for k in range(1, order):
            before = np.full(len(piece), EDGE, np.int64)
            before[k:] = piece[:-k]
            out |= np.where(inside, before << (8 * k), 0)
            inside &= before != EDGE
        first = np.concatenate([[0], np.flatnonzero(piece[:-1] == EDGE) + 1])
        yield first, out
        at = to


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, n0, n1: how often each gram stands in the ordinary and in the toxic texts of ``labelled`` (text, toxic)."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            toxic = np.array(batch.column(1).to_pylist(), bool)
            for lo, hi, w in text_chunks(batch.column(0)):
                stream, n = letters(w)
                of = np.repeat(toxic[lo:hi], n)
                at = 0
                for first, found in grams(stream, order):
                    mine = np.repeat(of[at : at + len(first)], np.diff(np.append(first, len(found))))
                    at += len(first)
                    held.append(tallied(found, np.stack([~mine, mine], 1).astype(np.int64)))
                if sum(len(k) for k, _ in held) > COUNTED_GRAMS:
                    held = [tallied(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > COUNTED_GRAMS // 2:
                        yield out(held.pop())
        if held:
            yield out(tallied(*map(np.concatenate, zip(*held, strict=True))))

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1][:, 0]), pa.array(rows[1][:, 1])], ["gram", "n0", "n1"])

    return labelled.select("text", "toxic").mapInArrow(run, "gram bigint, n0 bigint, n1 bigint").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def tallied(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed rows of counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def log_ratios(counts: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """key, value: log P_1 / P_0 of each seen gram under its ``gram``, and of each seen context's backoff under -1 - context."""
    gram, size = F.col("gram"), F.col("size")
    bytes_of = F.ceil(F.length(F.hex("gram")) / 2).cast("int")
    low = lambda c, n: c.bitwiseAND(F.pow(F.lit(2.0), 8 * n).cast("long") - 1)
    types = counts.select("gram", bytes_of.alias("size"))
    # Every gram with all its endings, by size; a gram's own row has the greatest.
    endings = types.select(F.col("gram").alias("of"), F.explode(F.sequence(F.lit(1), size)).alias("size"), gram).select("of", "size", low(gram, size).alias("gram"))
    # How many different bytes stand before an ending: its continuation count.
    follows = endings.select("size", "gram").distinct().filter("size > 1").select((size - 1).alias("size"), low(gram, size - 1).alias("gram")).groupBy("size", "gram").agg(F.count(F.lit(1)).alias("c"))
    context = F.shiftright("gram", 8)
    totals = follows.groupBy("size", context.alias("h")).agg(F.sum("c").alias("c_h"), F.count(F.lit(1)).alias("n_h"))
    steps = follows.withColumn("h", context).join(totals, ["size", "h"]).select("size", "gram", "c", "c_h", "n_h")
    chain = endings.join(types.select(F.col("gram").alias("of"), F.col("size").alias("whole")), "of").filter("size < whole").drop("whole").join(steps, ["size", "gram"])
    fold_in = lambda p, x: (F.greatest(x["c"] - discount, F.lit(0.0)) + discount * x["n_h"] * p) / x["c_h"]
    shared = chain.groupBy("of").agg(F.sort_array(F.collect_list(F.struct("size", "c", "c_h", "n_h"))).alias("steps")).select(F.col("of").alias("gram"), F.aggregate("steps", F.lit(1 / 256), fold_in).alias("p"))
    per = counts.groupBy(context.alias("h")).agg(*[F.sum(f"n{c}").alias(f"c{c}") for c in (0, 1)], *[F.count_if(F.col(f"n{c}") > 0).alias(f"k{c}") for c in (0, 1)])
    rest = lambda c: F.when(F.col(f"c{c}") > 0, discount * F.col(f"k{c}") / F.col(f"c{c}")).otherwise(F.lit(1.0))
    rows = counts.withColumn("h", context).join(per, "h").join(shared, "gram", "left")
    p = lambda c: F.greatest(F.col(f"n{c}") - discount, F.lit(0.0)) / F.greatest(F.col(f"c{c}"), F.lit(1)) + rest(c) * F.coalesce("p", F.lit(1 / 256))
    seen = rows.select(gram.alias("key"), F.log(p(1) / p(0)).cast("float").alias("value"))
    return seen.unionByName(per.select((-1 - F.col("h")).alias("key"), F.log(rest(1) / rest(0)).cast("float").alias("value")))


class Model:
    """Sorted keys of ``log_ratios`` and their values, in whole UNITs, so that sums are exact in any order."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.rint(values[order].astype(np.float64) * UNIT).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]

    def ratios(self, found: np.ndarray) -> np.ndarray:
        """log P_1 / P_0 of grams; an unseen gram has its context's backoff, an unseen context none."""
        same, inverse = np.unique(found, return_inverse=True)
        seen, value = self._find(same)
        known, backed = self._find(-1 - (same >> 8))
        return np.where(seen, value, np.where(known, backed, 0))[inverse]


def features(w, model: Model, order: int) -> np.ndarray:
    """By text: mean log ratio of its words, and the largest mean of each window length."""
    out = np.zeros((len(w), 1 + len(WINDOWS)))
    stream, n = letters(w)
    if not len(stream):
        return out
    words = np.concatenate([np.add.reduceat(model.ratios(found), first) for first, found in grams(stream, order)])
    ends = np.cumsum(n)
    own = np.flatnonzero(n > 0)
    first = (ends - n)[own]
    out[own, 0] = np.add.reduceat(words, first) / n[own] / UNIT
    sums = np.concatenate([[0], np.cumsum(words)])
    at, last = np.arange(len(words)), np.repeat(ends, n)
    for k, size in enumerate(WINDOWS):
        # A window that the text's end cuts keeps its full length as the divisor.
        out[own, 1 + k] = np.maximum.reduceat(sums[np.minimum(at + size, last)] - sums[at], first) / size / UNIT
    return out


FEATURES = [f"f{k}" for k in range(1 + len(WINDOWS))]


def score_features(docs: DataFrame, ratios: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, held_rows: int = HELD_ROWS) -> DataFrame:
    """Per row doc_id and FEATURES of the whole text; ``ratios``: a written table of ``log_ratios``.

    Up to ``held_rows`` rows go to the tasks; more meet the texts' grams in a
    join and come back by text, with the same result.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, T.DoubleType()) for n in FEATURES]])

    def columns(ids, parts):
        f = np.concatenate([*parts, np.zeros((0, len(FEATURES)))])
        return pa.RecordBatch.from_arrays([ids, *[pa.array(f[:, k]) for k in range(len(FEATURES))]], schema.names)

    if ratios.count() <= held_rows:
        table = ratios.toArrow()
        held = docs.sparkSession.sparkContext.broadcast(Model(table["key"].to_numpy(), table["value"].to_numpy()))

        def run(batches):
            for batch in batches:
                yield columns(batch.column(0), [features(w, held.value, order) for _, _, w in text_chunks(batch.column(1))])

        return rows.mapInArrow(run, schema)

    def asked(batches):
        for batch in batches:
            for lo, _, w in text_chunks(batch.column(1)):
                for k in range(len(w)):
                    one = batch.column(1).slice(lo + k, 1)
                    for _, _, x in text_chunks(one):
                        same = np.unique(np.concatenate([np.zeros(0, np.int64), *[g for _, g in grams(letters(x)[0], order)]]))
                    keys = np.unique(np.concatenate([same, -1 - (same >> 8)]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(keys), lo + k))), pa.array(keys)], ["text_key", "key"])

    def joined(batches):
        for batch in batches:
            parts = []
            for k in range(batch.num_rows):
                met = batch.column(2)[k].values
                model = Model(met.field("key").to_numpy(), met.field("value").to_numpy()) if met is not None else Model(np.zeros(0, np.int64), np.zeros(0, np.float32))
                parts += [features(w, model, order) for _, _, w in text_chunks(batch.column(1).slice(k, 1))]
            yield columns(batch.column(0), parts)

    texts = rows.withColumn("text_key", F.xxhash64("text"))
    keys = texts.filter("text is not null").select("text_key", "text").mapInArrow(asked, "text_key bigint, key bigint").distinct()
    met = keys.join(ratios, "key").groupBy("text_key").agg(F.collect_list(F.struct("key", "value")).alias("met"))
    return texts.join(met, "text_key", "left").select("doc_id", "text", "met").mapInArrow(joined, schema)


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method on standardised columns: means, scales, weights (last: intercept)."""
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held: int = 2, threshold: float = 0.3, calibration_rows: int = CALIBRATION_ROWS, order: int = ORDER, held_rows: int = HELD_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 if score >= ``threshold``), log_ratio.

    Labels of the ``held`` fold are never read.  Of the other labelled texts the
    first ``calibration_rows`` ids by hash order, at most a quarter, which the
    models have not seen, fit the probability; their rows go to the driver, a few
    numbers each.  The counts come from all the rest.

    Null or empty texts have ratio 0 and their score is what that gives;
    repeated rows each give a row; a document labelled twice is toxic if one
    label says so; null labels or ids teach nothing, and held_out is false for
    a null id; without labels every score is 0.5; other columns are not read.
    """
    part = fold("doc_id", folds)
    known = labels.filter((part != held) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = written(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxicity-labels")
    by_hash = F.xxhash64(F.lit("tune"), F.col("doc_id").cast("string"))
    rows = min(calibration_rows, known.count() // 4)
    last = known.select(by_hash.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    tune = F.lit(False) if last is None else by_hash <= last
    texts = docs.filter((part != held) & ~tune).select("doc_id", "text")
    counts = written(gram_counts(texts.join(known.filter(~tune), "doc_id"), order), "toxicity-counts")
    scored = written(score_features(docs, written(log_ratios(counts, order), "toxicity-ratios"), order=order, held_rows=held_rows), "toxicity")
    sample = scored.join(known.filter(tune), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(calibration_rows).select(*FEATURES, "toxic").toPandas()
    mean, scale, w = calibrate(sample[FEATURES].to_numpy(float), sample["toxic"].to_numpy(float))
    z = F.lit(float(w[-1]))
    for n, m, s, k in zip(FEATURES, mean, scale, w, strict=False):
        z = z + F.lit(float(k)) * (F.col(n) - F.lit(float(m))) / F.lit(float(s))
    score = F.lit(1.0) / (1.0 + F.exp(-z))
    return scored.select("doc_id", F.coalesce(part == held, F.lit(False)).alias("held_out"), score.alias("score"), F.when(score >= threshold, 1).otherwise(0).cast("int").alias("predicted"), F.col("f0").alias("log_ratio"))

"""Operator 8: language identification by multilingual mixture inference.

Every language has a model of byte trigrams inside words.  A document's words
are a mixture of languages; expectation-maximisation finds the proportions, and
among the best sets of one, two, ... languages the penalised likelihood
(half a logarithm of the number of words for each language) picks one: the set
grows by the next largest proportion as long as that is better.  Every document
stops by itself and word likelihoods add up in whole units, so its result does
not depend on the rows around it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_chunks
from .counting import SCHEMA, packed, summed

SLOTS = 1 << 18
#: A document's EM ends when no proportion moves by so much; a language counts from this proportion on.
MOVED, LEAST_PART = 1e-3, 0.01
#: Log-probabilities are whole multiples of 1 / UNIT.
UNIT = 1 << 16
#: Pseudo-counts that the pooled model of all languages lends to each.
PRIOR = 2000.0
_U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.zeros(256, np.uint32)
_FOLD[_LETTER] = np.arange(256)[_LETTER]
_FOLD[65:91] += 32


def _grams(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slot of the trigram that ends at each byte, and starts and ends of words of letters."""
    code = _FOLD[raw]
    before, second = np.zeros_like(code), np.zeros_like(code)
    before[1:] = code[:-1]
    second[2:] = code[:-2]
    inside = breaks[(breaks > 0) & (breaks < len(raw))]
    before[inside] = 0
    second[inside] = 0
    second[inside[inside + 1 < len(raw)] + 1] = 0
    second[before == 0] = 0
    slot = ((second * np.uint32(65536) + before * np.uint32(256) + code) * np.uint32(0x9E3779B1)) >> np.uint32(14)
    letter = code > 0
    first = letter & (before == 0)
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    last[inside - 1] = letter[inside - 1]
    return slot.astype(np.int32), np.flatnonzero(first), np.flatnonzero(last) + 1


class Model:
    """Log-probabilities by language and slot."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        pooled = sum((counts[x] for x in self.langs), np.zeros(SLOTS)) + 0.5
        pooled = pooled / pooled.sum()
        self.table = np.stack([np.rint(np.log((counts[x] + PRIOR * pooled) / (counts[x].sum() + PRIOR)) * UNIT).astype(np.int32) for x in self.langs]) if counts else np.zeros((0, SLOTS), np.int32)

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[str, float, list[tuple[str, float]]]]:
        """(language, score, proportions of the chosen set) by text; ``und`` where there is no letter or no model."""
        n_docs = len(offsets) - 1
        slot, starts, ends = _grams(raw, offsets)
        at = np.searchsorted(starts, offsets)
        n = np.diff(at)
        out: list = [("und", 0.0, [])] * n_docs
        own = np.flatnonzero(n > 0)
        if not len(own) or not self.langs:
            return out
        n_langs = len(self.langs)
        loglik = np.empty((len(starts), n_langs))
        for k in range(n_langs):
            sums = np.concatenate([[0], np.cumsum(self.table[k][slot], dtype=np.int64)])
            loglik[:, k] = (sums[ends] - sums[starts]) / UNIT
        top = loglik.max(axis=1, keepdims=True)
        like = np.exp(loglik - top).astype(np.float32)
        first, count = at[:-1][own], n[own]
        base = np.add.reduceat(top[:, 0], first)
        share, _ = fitted(like, count, np.ones((len(own), n_langs)))
        order = np.argsort(-share, axis=1, kind="stable")
        single = np.add.reduceat(loglik, first, axis=0)
        rows = np.arange(len(own))
        best = np.argmax(single, axis=1)
        chosen = np.zeros((len(own), n_langs))
        chosen[rows, best] = 1.0
        penalty = 0.5 * np.log(count + 1.0)
        value = single[rows, best] - penalty
        doc = np.repeat(rows, count)
        grows = np.ones(len(own), bool)
        for size in range(2, n_langs + 1):
            grows &= share[rows, order[:, size - 1]] > LEAST_PART
            some = np.flatnonzero(grows)
            if not len(some):
                break
            allowed = np.zeros((len(some), n_langs))
            np.put_along_axis(allowed, order[some, :size], 1.0, axis=1)
            got, fit = fitted(like[grows[doc]], count[some], allowed)
            fit += base[some] - size * penalty[some]
            better = fit > value[some]
            chosen[some[better]], value[some[better]] = got[better], fit[better]
            grows[some[~better]] = False
        win = np.argmax(chosen, axis=1)
        score = np.clip(share[rows, win], 0.0, 1.0)
        for j, d in enumerate(own.tolist()):
            parts = [(self.langs[k], float(chosen[j, k])) for k in np.flatnonzero(chosen[j] > LEAST_PART)]
            out[d] = self.langs[win[j]], float(score[j]), sorted(parts, key=lambda x: -x[1])
        return out


def fitted(like: np.ndarray, count: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions, 0 where not ``allowed``, and log-likelihoods of documents of ``count`` rows each of ``like``.

    A document's rounds go on until no proportion moves by MOVED; each raises its
    likelihood, so there is an end.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    on, rows, n = np.arange(len(count)), like, count
    while True:
        doc = np.repeat(np.arange(len(on)), n)
        part = rows * share[on][doc].astype(np.float32)
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        new = np.add.reduceat(part, np.cumsum(n) - n, axis=0) / n[:, None]
        moved = np.abs(new - share[on]).max(axis=1) >= MOVED
        share[on] = new
        if not moved.any():
            break
        if not moved.all():
            on, rows, n = on[moved], rows[moved[doc]], n[moved]
    total = np.maximum((like * share[np.repeat(np.arange(len(count)), count)].astype(np.float32)).sum(axis=1), 1e-30)
    return share, np.add.reduceat(np.log(total.astype(np.float64)), np.cumsum(count) - count)


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram counts of all rows with text and language; SLOTS numbers a language come to the driver."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            for lang in sorted(set(langs.to_pylist())):
                mine = texts.filter(pa.array([x == lang for x in langs.to_pylist()]))
                for _, _, w in text_chunks(mine):
                    slot, _, _ = _grams(w.raw, w.text_offsets)
                    got = np.bincount(slot[_LETTER[w.raw]], minlength=SLOTS)
                    if lang in counts:
                        counts[lang] += got
                    else:
                        counts[lang] = got.astype(np.int64)
        yield from packed(counts)

    return Model(summed(rows.mapInArrow(run, SCHEMA), SLOTS))


def _predictions(texts: pa.Array, model: Model) -> list[tuple[str, float, list[tuple[str, float]]]]:
    """``Model.predict`` for a column of texts, with ``und`` where a text has no letter."""
    out = []
    for _, _, w in text_chunks(texts):
        ascii_letter = np.add.reduceat(np.append(_LETTER[w.raw] & (w.raw < 128), False).astype(np.int64), np.minimum(w.text_offsets[:-1], len(w.raw)))
        empty = np.diff(w.text_offsets) == 0
        for k, (lang, score, part) in enumerate(model.predict(w.raw, w.text_offsets)):
            if lang != "und" and (empty[k] or not ascii_letter[k]):
                text = w.raw[w.text_offsets[k] : w.text_offsets[k + 1]].tobytes().decode()
                if not any(map(str.isalpha, text)):
                    lang, score, part = "und", 0.0, []
            out.append((lang, score, part))
    return out


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, languages (array of language and proportion, largest first).

    ``und`` with score 0 and no languages where the text is null or without a
    letter, or where nothing was learned.  ``score`` is the predicted
    language's proportion among all learned languages.  Repeated rows each give
    a row; an empty table an empty table; other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    mixture = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", mixture)])
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = _predictions(batch.column(1), held.value)
            langs, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            parts = pa.array([[{"lang": a, "share": b} for a, b in x[2]] for x in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), langs, scores, parts], schema.names)

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, least: float, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``identify`` names a language with a score of at least ``least``; no row is moved."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = [lang != "und" and score >= least for lang, score, _ in _predictions(batch.column(at), held.value)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def fold_model(docs: DataFrame, *, folds: int = 3, held: int = 1) -> Model:
    return learn(docs.filter(fold("doc_id", folds) != held))


def predicted_languages(docs: DataFrame, *, folds: int = 3, held: int = 1) -> DataFrame:
    """``identify`` with a model learned from the rows not held out; held_out is false for a null id, from which nothing is learned."""
    part = fold("doc_id", folds)
    return identify(docs, fold_model(docs, folds=folds, held=held)).withColumn("held_out", F.coalesce(part == held, F.lit(False)))

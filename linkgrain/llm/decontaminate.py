"""Operator 10: benchmark decontamination with SimHash windows.

A window is as long as a benchmark item and lies where a document shares a
shingle with that item, aligned on it; any other window has similarity 0 and
needs no fingerprint.  A window's 64-bit SimHash over its words goes through a
multi-index of BLOCKS blocks, asked in each for all values within
RADIUS // BLOCKS bits: of BLOCKS blocks one differs in at most that many, so it
shows every item within RADIUS bits.  Around what it shows, the weighted
similarity of word shingles decides exactly.  A shingle's weight falls with the
number of items that hold it, counted over all items in Spark.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Words, doc_index, mix64, text_chunks

BLOCKS, BLOCK_BITS = 4, 16
RADIUS = 23
SHINGLE = 5
SIMILARITY = 0.8
#: Items whose tables go to the executors at once, about 2 KB an item of 50 words; more items take more passes.
ITEMS_AT_ONCE = 16_384
#: Fingerprints whose items a task remembers.
KNOWN_PRINTS = 100_000
_BITMAP = 1 << 24
_U = np.uint64


def _signs(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each hash."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprint(words: np.ndarray) -> np.uint64:
    """SimHash of the words: a bit is set that more than half of the words' hashes have."""
    ones = _signs(words).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(words)).view("<u8")[0]


def _neighbours(width: int, within: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(within + 1) for c in combinations(range(width), r)], np.int64)


class ItemIndex:
    """Hashed items, their weights by shingle, and the block tables of their fingerprints."""

    def __init__(self, ids: list[int], texts: list[str], common: tuple[np.ndarray, np.ndarray]):
        order = sorted((t or "", i) for i, t in zip(ids, texts, strict=True))
        ids, texts = [i for _, i in order], pa.array([t for t, _ in order], pa.string())
        words = [w.of(i) for _, _, w in text_chunks(texts) for i in range(len(w))]
        keep = [k for k, w in enumerate(words) if len(w)]
        self.ids, self.words = [ids[k] for k in keep], [words[k] for k in keep]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.shingles = [item_shingles(w) for w in self.words]
        #: Sorted shingles of two items or more, and their weights; any other weighs 1.
        self.common, self.common_weight = common
        self.prints = np.array([fingerprint(w) for w in self.words], np.uint64)
        self.known: dict[int, np.ndarray] = {}
        self.around = _neighbours(BLOCK_BITS, RADIUS // BLOCKS)
        self.tables = []
        for block in range(BLOCKS):
            slots = self._slot(self.prints, block)
            order = np.argsort(slots, kind="stable")
            begin = np.searchsorted(slots[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32)
            self.tables.append((begin, order.astype(np.int32)))
        #: By shingle length, the places of each shingle in the items.
        self.places = {}
        for k in sorted({min(SHINGLE, n) for n in self.size.tolist()}):
            of = [i for i, n in enumerate(self.size.tolist()) if min(SHINGLE, n) == k]
            rolled = [roll(self.words[i], k) for i in of]
            keys = np.concatenate(rolled)
            item, offset = np.repeat(of, [len(r) for r in rolled]), np.concatenate([np.arange(len(r)) for r in rolled])
            order = np.argsort(keys, kind="stable")
            there = np.zeros(_BITMAP >> 3, np.uint8)
            np.bitwise_or.at(there, (keys & _U(_BITMAP - 1)).astype(np.int64) >> 3, (1 << (keys & _U(7))).astype(np.uint8))
            self.places[k] = keys[order], item[order], offset[order], there

    @staticmethod
    def _slot(prints: np.ndarray, block: int) -> np.ndarray:
        return ((prints >> _U(BLOCK_BITS * block)) & _U((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def near(self, window: np.uint64) -> np.ndarray:
        """Items within RADIUS bits of a window's fingerprint."""
        key = int(window)
        if key not in self.known:
            if len(self.known) >= KNOWN_PRINTS:
                self.known.clear()
            prints, shown = np.array([window], np.uint64), []
            for block, (begin, items) in enumerate(self.tables):
                slots = self._slot(prints, block)[0] ^ self.around
                for s in slots[begin[slots + 1] > begin[slots]].tolist():
                    shown.append(items[begin[s] : begin[s + 1]])
            found = np.unique(np.concatenate([*shown, np.zeros(0, np.int32)]))
            self.known[key] = found[np.bitwise_count(self.prints[found] ^ window) <= RADIUS]
        return self.known[key]

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.ones(len(shingles))
        at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
        return np.where(self.common[at] == shingles, self.common_weight[at], 1.0)

    def similarity(self, item: int, words: np.ndarray, at: int) -> tuple[float, int]:
        """The best weighted Jaccard of the item with a run of its size that starts near ``at``, and that start."""
        n = int(self.size[item])
        k = min(SHINGLE, n)
        lo, hi = max(0, at - n // 4 - 1), max(0, min(len(words) - n, at + n // 4 + 1))
        own = self.shingles[item]
        rolled = roll(words[lo : hi + n], k)
        best, where = 0.0, lo
        shared = np.isin(rolled, own)
        if not shared.any():
            return best, where
        own_weight = self.weights(own)
        for start in range(lo, max(lo, min(hi, len(words) - 1)) + 1):
            run = np.unique(rolled[start - lo : start - lo + n - k + 1])
            if not len(run):
                continue
            both = own_weight[np.isin(own, run)].sum()
            got = both / (own_weight.sum() + self.weights(run).sum() - both)
            if got > best:
                best, where = float(got), start
        return best, where


def roll(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order."""
    m = len(h) - size + 1
    if m <= 0 or not len(h):
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(size):
        out = mix64(out * _U(0x9E3779B97F4A7C15) + h[k : k + m] + _U(k + 1))
    return out


def item_shingles(words: np.ndarray) -> np.ndarray:
    return np.unique(roll(words, min(SHINGLE, len(words))))


def common_shingles(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of two or more of the items (``text``), sorted, and their weights: 1 / (1 + log of the number of items)."""

    def run(batches):
        for batch in batches:
            for _, _, w in text_chunks(batch.column(0)):
                found = [item_shingles(w.of(i)) for i in range(len(w)) if len(w.of(i))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["shingle"])

    rows = items.select("text").mapInArrow(run, "shingle bigint").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").toArrow()
    shingles, n = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(shingles)
    return shingles[order], 1.0 / (1.0 + np.log(n[order]))


def _windows(w: Words, index: ItemIndex) -> set[tuple[int, int, int]]:
    """(text, start, length) of the windows aligned on a shingle shared with an item."""
    found: set[tuple[int, int, int]] = set()
    doc = doc_index(w.offsets)
    for k, (keys, item, offset, there) in index.places.items():
        rolled = roll(w.hashes, k)
        if not len(rolled):
            continue
        low = (rolled & _U(_BITMAP - 1)).astype(np.int64)
        hit = np.flatnonzero((there[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
        hit = hit[doc[hit] == doc[hit + k - 1]]
        a, b = np.searchsorted(keys, rolled[hit]), np.searchsorted(keys, rolled[hit], "right")
        n = b - a
        at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place, size = np.repeat(hit, n) - offset[at], index.size[item[at]]
        d = doc[np.repeat(hit, n)]
        start = np.maximum(w.offsets[d], np.minimum(place, w.offsets[d + 1] - size))
        rows = np.unique(np.stack([d, start - w.offsets[d], size], 1), axis=0)
        found.update(map(tuple, rows.tolist()))
    return found


def _matches(w: Words, index: ItemIndex):
    """(text, item, similarity, start) for the best place of every item found in a text."""
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for d, start, size in sorted(_windows(w, index)):
        words = w.of(d)
        for i in index.near(fingerprint(words[start : start + size])).tolist():
            if (d, i) in best and best[d, i][0] >= 1.0:
                continue
            got, where = index.similarity(i, words, start)
            if got >= SIMILARITY and got > best.get((d, i), (0.0, 0))[0]:
                best[d, i] = got, where
    return [(d, i, s, at) for (d, i), (s, at) in best.items()]


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and benchmark item that it holds: doc_id, item_id, similarity, start_word, n_words.

    A document holds an item if a run of its words of the item's length has a
    weighted Jaccard similarity of at least SIMILARITY with the item, over sets
    of SHINGLE-word shingles (of all words of a shorter item), A-Z lower-cased.
    A shingle of n items weighs 1 / (1 + log n), any other 1.  The benchmark is
    the stated query set: it passes through the driver ITEMS_AT_ONCE items at a
    time, each pass over all documents; the result does not depend on the passes.

    Null or empty texts and items without a word hold and match nothing;
    repeated rows each give their rows, and equal items are each reported; an
    empty table on either side gives no rows; other columns are not read.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    wanted = items.select(items[item_col].alias("item_id"), items[item_text_col].alias("text"))
    schema = T.StructType([rows.schema["doc_id"], wanted.schema["item_id"], T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType())])
    context = docs.sparkSession.sparkContext

    def job(index):
        def run(batches):
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                take, out = [], []
                for lo, _, w in text_chunks(texts):
                    for d, i, s, at in _matches(w, index.value):
                        take.append(lo + d)
                        out.append((index.value.ids[i], s, at, int(index.value.size[i])))
                if take:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), pa.array(cols[0]).cast(item_type), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], schema.names)

        return run

    item_type = to_arrow_type(wanted.schema["item_id"].dataType)
    found, common = None, common_shingles(wanted)
    for part in _portions(wanted):
        index = ItemIndex([r[0] for r in part], [r[1] for r in part], common)
        if not index.ids:
            continue
        got = rows.mapInArrow(job(context.broadcast(index)), schema)
        found = got if found is None else found.unionByName(got)
    return found if found is not None else rows.sparkSession.createDataFrame([], schema)


def _portions(items: DataFrame):
    part = []
    for row in items.filter(F.col("text").isNotNull()).toLocalIterator():
        part.append(row)
        if len(part) == ITEMS_AT_ONCE:
            yield part
            part = []
    if part:
        yield part

"""Operator 1: repeated passages by a sparse suffix array.

1. Suffixes are retained where a run of GRAM words is the smallest of WINDOW
   successive runs, a choice that only depends on the words themselves.  A
   passage of ``min_words`` words holds such a place with LEFT words before and
   RIGHT words after it inside the passage, the same place in every copy.
2. Suffixes whose context (those LEFT and RIGHT words) stands more than once are
   sorted by context, document and place.  Each carries hashes of the words that
   a passage through its context can reach, so texts stay where they are.
3. Neighbours in that order are compared and the match is extended left and
   right; matches of ``min_words`` words count.  The earlier neighbour comes
   first in the documents' order, so a match is a repeat of an earlier place.
4. Where a run of three or more holds windows of ``min_words`` words that no
   such match covers, its suffixes are sorted by the words after the context, and
   by those before it; what a place shares with its neighbours there bounds what
   it shares with any.  Windows within these bounds are fingerprinted whole and
   grouped.  The earliest place of a window is in no match, as nothing equals it
   before, so a later copy is in a match with its neighbour or meets it here.

A context that very many places have is sorted in parts of about HOT places by a
hash of the document; a part's first place has its windows open, so step 4 ties
the parts together and nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, doc_index, mix64, released, text_chunks, unused_name, written

GRAM = 6
MIN_WORDS = 50
#: Places of one context that are sorted together.
HOT = 20_000
#: A span is the runs before times SPAN and the runs after.
SPAN = 1 << 16
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_INV = pow(_BASE, -1, 1 << 64)


def shape(min_words: int) -> tuple[int, int, int]:
    """WINDOW, LEFT, RIGHT with WINDOW + LEFT + RIGHT = min_words + 1."""
    window = min_words // 2 - 1
    left = (min_words + 1 - window) // 2
    return window, left, min_words + 1 - window - left


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p)


def _slide(v: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over ``size`` successive values."""
    have = 1
    while have < size:
        step = min(have, size - have)
        v = pick(v[:-step], v[step:])
        have += step
    return v


def places(w: Words, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word number, context, span) of the retained suffixes; span tells the windows of which it is the smallest."""
    window, left, right = shape(min_words)
    h, n = w.hashes, len(w.hashes)
    if n < min_words:
        return (np.zeros(0, np.int64),) * 4
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _powers(_BASE, n), out=total[1:])
    inverse = _powers(_INV, n + 1)
    gram = mix64((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    low = _slide(gram, window, np.minimum)
    # A run is chosen if some window around it has it as its smallest.
    padded = np.concatenate([np.zeros(window - 1, np.uint64), low, np.zeros(window - 1, np.uint64)])
    chosen = np.flatnonzero(gram == _slide(padded, window, np.maximum))
    doc = doc_index(w.offsets)
    at = chosen[(chosen >= left) & (chosen + right <= n)]
    at = at[(doc[at - left] == doc[at]) & (doc[at + right - 1] == doc[at])]
    # So many runs before it are larger, and after it no smaller; every window has one leftmost smallest run.
    reach = []
    for step, larger in ((-1, np.greater), (1, np.greater_equal)):
        far, on = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for k in range(1, window):
            there = at + step * k
            on &= (there >= 0) & (there < len(gram))
            on &= larger(gram[np.clip(there, 0, len(gram) - 1)], gram[at])
            far += on
        reach.append(far)
    keep = reach[0] + reach[1] >= window - 1
    at, span = at[keep], (reach[0] * SPAN + reach[1])[keep]
    context = mix64((total[at + right] - total[at - left]) * inverse[at - left]).view(np.int64)
    return doc[at], at - w.offsets[doc[at]], context, span


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, text of the rows with id and text: rows of one id and different texts are different documents."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def suffixes(rows: DataFrame, min_words: int) -> DataFrame:
    """context, doc_id, text_key, at (word number), span of every retained suffix."""

    def run(batches):
        for batch in batches:
            for lo, _, w in text_chunks(batch.column(2)):
                doc, at, context, span = places(w, min_words)
                if len(at):
                    of = pa.array(doc + lo)
                    yield pa.RecordBatch.from_arrays([pa.array(context), batch.column(0).take(of), batch.column(1).take(of), pa.array(at), pa.array(span)], ["context", "doc_id", "text_key", "at", "span"])

    return rows.mapInArrow(run, "context bigint, doc_id bigint, text_key bigint, at bigint, span bigint")


def around(own: np.ndarray, at: np.ndarray, min_words: int) -> np.ndarray:
    """A row of word hashes for each place: those before its context from near to far, then those after it; 0 beyond the text."""
    _, left, right = shape(min_words)
    reach = min_words - left - right
    offsets = np.concatenate([-left - 1 - np.arange(reach), right + np.arange(reach)])
    index = at[:, None] + offsets
    words = np.maximum(own[np.clip(index, 0, len(own) - 1)] >> _U(32), _U(1)).astype(np.uint32)
    return np.where((index >= 0) & (index < len(own)), words, np.uint32(0))


def surrounded(rows: DataFrame, runs: DataFrame, min_words: int) -> DataFrame:
    """``runs`` (context, doc_id, text_key, at, span, c) with ``words``, the bytes of ``around``, from the documents' texts."""
    per = runs.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("at", "context", "span", "c")).alias("places"))
    both = rows.join(per, ["doc_id", "text_key"])

    def run(batches):
        for batch in batches:
            places = batch.column(3)
            for k in range(batch.num_rows):
                own = np.concatenate([w.hashes for _, _, w in text_chunks(batch.column(2).slice(k, 1))])
                met = places[k].values
                at, context, span, c = (met.field(f) for f in ("at", "context", "span", "c"))
                words = around(own, at.to_numpy(), min_words)
                n, width = len(words), words.shape[1] * 4
                data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(words.astype("<u4").tobytes())])
                ids = [pa.array(np.full(n, batch.column(i)[k].as_py(), np.int64)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([context, *ids, at, span, c, data], ["context", "doc_id", "text_key", "at", "span", "c", "words"])

    return both.select("doc_id", "text_key", "text", "places").mapInArrow(run, "context bigint, doc_id bigint, text_key bigint, at bigint, span bigint, c bigint, words binary")


FOUND = "doc_id bigint, text_key bigint, start_word bigint, end_word bigint, first_doc_id bigint, first_start_word bigint, window bigint, check bigint"
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


class Neighbours:
    """Compares the places of a context, sorted by document and place, each with the one before it."""

    def __init__(self, min_words: int, hot: int):
        self.hot = hot
        _, self.left, self.right = shape(min_words)
        self.reach = min_words - self.left - self.right
        rng = np.random.default_rng(20240102)
        self.factors = [rng.integers(1, 1 << 63, 2 * self.reach, dtype=np.uint64) | _U(1) for _ in range(2)]

    def found(self, keys: np.ndarray, words: np.ndarray, begin: int = 0):
        """Columns of passages and of open windows; ``keys``: context, part, doc_id, text_key, at, span, c; rows before ``begin`` are only compared with."""
        n, r = len(keys), self.reach
        same = np.zeros(n, bool)
        same[1:] = (keys[1:, :2] == keys[:-1, :2]).all(axis=1)
        # A repeated row is the same place, no neighbour.
        again = np.zeros(n, bool)
        again[1:] = same[1:] & (keys[1:, 2:5] == keys[:-1, 2:5]).all(axis=1)
        equal = np.zeros(words.shape, bool)
        equal[1:] = (words[1:] == words[:-1]) & (words[1:] != 0) & same[1:, None]
        before, after = (_leading(x) for x in (equal[:, :r], equal[:, r:]))
        hit = np.flatnonzero(same & ~again & (before + after >= r))
        hit = hit[hit >= begin]
        start = self.left + before[hit]
        passages = [keys[hit, 2], keys[hit, 3], keys[hit, 4] - start, keys[hit, 4] + self.right + after[hit], keys[hit - 1, 2], keys[hit - 1, 4] - start]
        # Window j has r - j words before the context and j after it; each window is looked at from its smallest run alone.
        j = np.arange(r + 1)
        open_ = (j >= r - keys[:, 5:6] // SPAN) & (j <= keys[:, 5:6] % SPAN)
        open_ &= (r - j <= _leading(words[:, :r] != 0)[:, None]) & (j <= _leading(words[:, r:] != 0)[:, None])
        open_ &= ~(same[:, None] & (r - j <= before[:, None]) & (j <= after[:, None]))
        open_ &= ((keys[:, 6] > 2) & ~again)[:, None]
        run = np.cumsum(~same)
        hot = keys[:, 6] > self.hot
        self._shared(open_, words, run, hot | again)
        # The first of a run is asked for its windows only if a later place has open ones.
        asked = np.zeros(n + 1, bool)
        asked[run[same & open_.any(axis=1)]] = True
        open_[~(asked[run] | hot)] = False
        open_[:begin] = False
        some = np.flatnonzero(open_.any(axis=1))
        row, col = np.nonzero(open_[some])
        keys, words, prints = keys[some], words[some].astype(np.uint64), []
        for f in self.factors:
            sides = [np.concatenate([np.zeros((len(some), 1), np.uint64), np.cumsum(x, axis=1, dtype=np.uint64)], axis=1) for x in np.split(words * f, 2, axis=1)]
            prints.append(mix64(keys[row, 0].view(np.uint64) + sides[0][row, r - col] + sides[1][row, col]).view(np.int64))
        return passages, [keys[row, 2], keys[row, 3], keys[row, 4] - self.left - r + col, *prints]

    def _shared(self, open_: np.ndarray, words: np.ndarray, run: np.ndarray, always: np.ndarray) -> None:
        """Closes windows that no place of the run can share: sorted by the words after the context, and by those before, a place's neighbours agree with it longest."""
        late = np.zeros(run[-1] + 1 if len(run) else 0, bool)
        late[run[open_.any(axis=1)]] = True
        some = np.flatnonzero(late[run]) if len(run) else np.zeros(0, np.int64)
        if not len(some):
            return
        r = self.reach
        longest = []
        for side in (words[some, :r], words[some, r:]):
            order = np.lexsort([*side.T[::-1], run[some]])
            side, of = side[order], run[some][order]
            met = _leading((side[1:] == side[:-1]) & (side[1:] != 0) & (of[1:] == of[:-1])[:, None])
            best = np.zeros(len(some), np.int64)
            best[order[1:]] = met
            best[order[:-1]] = np.maximum(best[order[:-1]], met)
            longest.append(np.where(always[some], r, best))
        j = np.arange(r + 1)
        open_[some] &= (r - j <= longest[0][:, None]) & (j <= longest[1][:, None])


def _leading(same: np.ndarray) -> np.ndarray:
    """How many leading values of each row are true."""
    return np.where(same.all(axis=1), same.shape[1], np.argmin(same, axis=1)) if same.shape[1] else np.zeros(len(same), np.int64)


def whole_runs(batches, hot: int):
    """(keys, words, begin) of rows by whole runs of a context and part; a run of more than 4 * ``hot`` rows, which one text can make, comes in slices."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, begin = 0, 0

    def joined():
        return np.concatenate([k for k, _ in held]), np.concatenate([w for _, w in held])

    for keys, words in batches:
        last = int(np.flatnonzero((keys[:, :2] != keys[-1, :2]).any(axis=1))[-1:].sum() + 1) if (keys[:, :2] != keys[-1, :2]).any() else 0
        new = bool(held) and (held[-1][0][-1, :2] != keys[0, :2]).any()
        if last or new:
            held.append((keys[:last], words[:last]))
            yield *joined(), begin
            held, size, begin = [], 0, 0
        held.append((keys[last:], words[last:]))
        size += len(keys) - last
        if size > 4 * hot:
            k, w = joined()
            k[:, 6] = np.maximum(k[:, 6], hot + 1)
            yield k, w, begin
            held, size, begin = [(k[-1:], w[-1:])], 1, 1
    if held:
        yield *joined(), begin


def compared(runs: DataFrame, min_words: int) -> DataFrame:
    """FOUND of the ``runs``, which are dealt by context and part and sorted: passages, and open windows (those have ``window``)."""
    hot = HOT
    part = F.when(F.col("c") > hot, F.pmod(F.xxhash64("doc_id", "text_key"), F.ceil(F.col("c") / hot))).otherwise(F.lit(0)).cast("long")
    rows = runs.withColumn("part", part).repartition("context", "part").sortWithinPartitions("context", "part", "doc_id", "text_key", "at")

    def arrays(batches):
        for batch in batches:
            if batch.num_rows:
                data = batch.column(7)
                at = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4)
                words = np.frombuffer(data.buffers()[2], "<u4", (at[-1] - at[0]) // 4, int(at[0])).reshape(len(data), -1)
                yield np.stack([batch.column(i).to_numpy() for i in range(7)], axis=1), words

    def run(batches):
        look = Neighbours(min_words, hot)
        for keys, words, begin in whole_runs(arrays(batches), hot):
            passages, windows = look.found(keys, words, begin)
            n, m = len(passages[0]), len(windows[0])
            none = lambda k: pa.nulls(k, pa.int64())
            if n:
                yield pa.RecordBatch.from_arrays([*map(pa.array, passages), none(n), none(n)], _NAMES)
            if m:
                yield pa.RecordBatch.from_arrays([*map(pa.array, windows[:3]), none(m), none(m), none(m), *map(pa.array, windows[3:])], _NAMES)

    return rows.select("context", "part", "doc_id", "text_key", "at", "span", "c", "words").mapInArrow(run, FOUND)


def merged(found: DataFrame) -> DataFrame:
    """A row per maximal passage of a document from pieces that overlap; the earlier place is that of its leftmost piece."""
    by = Window.partitionBy("doc_id", "text_key")
    order = by.orderBy("start_word", F.col("end_word").desc(), "first_doc_id", "first_start_word")
    until = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # A window's partition is one document.
    rows = found.withColumn("_new", F.when(F.col("start_word") < until, 0).otherwise(1)).withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    least = F.min_by(F.struct("first_doc_id", "first_start_word"), F.struct("start_word", -F.col("end_word"), "first_doc_id", "first_start_word"))
    rows = rows.groupBy("doc_id", "text_key", "_n").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), least.alias("f"))
    return rows.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), F.col("f.first_doc_id"), F.col("f.first_start_word"), "text_key")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row per repeated passage but its first occurrence: doc_id, start_word, end_word, n_words, first_doc_id, first_start_word, text_key.

    A word is in a repeated passage if a run of ``min_words`` words (A-Z
    lower-cased) around it stands at an earlier place too, in the order of
    document id, text hash and place; also in the same document, where the two
    may overlap.  Passages are as long as such runs overlap; first_doc_id and
    first_start_word name an earlier place of the passage's beginning.

    Null or empty texts and texts of fewer than ``min_words`` words have none;
    rows with a null id take no part; repeated rows with one id and one text
    are one document, rows with one id and different texts (``text_key``, a
    hash of the text) are different ones; an empty table gives no rows; other
    columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    found = written(suffixes(rows, min_words), "suffixes")
    # Written, so that the join's other side is a plain exchange of rows, which AQE can split at a hot context.
    many = written(found.groupBy("context").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "suffix-contexts")
    runs = written(found.join(many, "context"), "suffix-runs")
    released(found, many)
    matches = written(compared(surrounded(rows, runs, min_words), min_words), "suffix-matches")
    released(runs)
    windows = matches.filter("window is not null").select("window", "check", "doc_id", "text_key", "start_word")
    heads = windows.groupBy("window", "check").agg(F.min(F.struct("doc_id", "text_key", "start_word")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = windows.join(heads, ["window", "check"]).filter(F.struct("doc_id", "text_key", "start_word") != F.col("f"))
    again = again.select("doc_id", "text_key", "start_word", (F.col("start_word") + min_words).alias("end_word"), F.col("f.doc_id").alias("first_doc_id"), F.col("f.start_word").alias("first_start_word"))
    return merged(matches.filter("window is null").drop("window", "check").unionByName(again))


def without_passages(docs: DataFrame, passages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of their ``passages`` cut out of the text, and nothing else changed.

    The column order stays.  Rows without passages, and with a null id or text,
    stay as they are; white space before a cut stays, that after its last word
    goes.  A passage belongs to the rows of its id and its ``text_key``, so
    repeated rows are cut alike and other texts of the id are not; columns of
    any name pass through.
    """
    names = docs.columns
    spans_col, id_key, text_key = (unused_name(x, names) for x in ("spans", "id", "text_key"))
    spans = passages.groupBy(F.col("doc_id").alias(id_key), F.col("text_key").alias(text_key)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(spans_col))
    # One plan at every size: the passages grow with the documents.
    same = (docs[id_col].cast("long") == F.col(id_key)) & (F.xxhash64(docs[text_col]) == F.col(text_key))
    rows = docs.join(spans.hint("merge"), same, "left").drop(id_key, text_key)
    text_at, spans_at = names.index(text_col), len(names)

    def run(batches):
        for batch in batches:
            texts = batch.column(text_at)
            spans = batch.column(spans_at)
            if spans.null_count < len(spans):
                new = texts.to_pylist()
                for k in np.flatnonzero(~np.asarray(spans.is_null())).tolist():
                    if new[k] is not None:
                        new[k] = cut(texts.slice(k, 1), [(s["start_word"], s["end_word"]) for s in spans[k].as_py()])
                texts = pa.array(new, texts.type)
            columns = [texts if i == text_at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select(*[rows[f"`{n}`"] for n in names], spans_col).mapInArrow(run, docs.schema)


def cut(text: pa.Array, spans: list[tuple[int, int]]) -> str:
    """One text without the words of ``spans``."""
    (_, _, w), *_ = text_chunks(text)
    raw, keep = w.raw, np.ones(len(w.raw), bool)
    for a, b in spans:
        b = min(b, len(w.starts))
        if a < b:
            keep[w.starts[a] : w.starts[b] if b < len(w.starts) else len(raw)] = False
    return raw[keep].tobytes().decode()

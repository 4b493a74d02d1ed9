"""Helpers that several operators share: scratch tables and word fingerprints.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, on UTF-8 bytes; no byte
of a multi-byte character is white space, so bytes and characters agree.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_CODES = _CODES[_LOWER]
_POWERS: dict[str, np.ndarray] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where unset, as in tests, the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: the lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/linkgrain/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def released(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused_name(wish: str, names: list[str]) -> str:
    """``wish`` with as many underscores before it as no column in ``names`` has."""
    taken = {n.lower() for n in names}
    while wish in taken:
        wish = "_" + wish
    return wish


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "b" not in _POWERS or len(_POWERS["b"]) < n:
        m = max(n, CHUNK_BYTES + 1)
        for k, v in (("b", _BASE), ("i", _INV)):
            p = np.full(m, v, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS["b"], _POWERS["i"]


def _hash_span(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and hashes of bytes; ``breaks``: offsets at which words end besides white space."""
    n = len(raw)
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inside = breaks[(breaks > 0) & (breaks < n)]
    first[inside] = word[inside]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inside - 1] = word[inside - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    b, inv = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER_CODES[raw] * b[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inv[starts]
    return starts, ends, mix64(h + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: ``hashes`` in order, ``offsets`` by text, byte ``starts`` and ``ends`` in ``raw``."""

    __slots__ = ("raw", "text_offsets", "hashes", "offsets", "starts", "ends")

    def __init__(self, raw: np.ndarray, text_offsets: np.ndarray):
        parts, at, n = [], 0, len(raw)
        while at < n:  # bounded pieces, cut where no word is cut
            to = min(n, at + CHUNK_BYTES)
            while to < n:
                near = np.flatnonzero(_SPACE[raw[max(at, to - 65536) : to]])
                if len(near):
                    to = max(at, to - 65536) + int(near[-1]) + 1
                    break
                cut = text_offsets[(text_offsets > at) & (text_offsets <= to)]
                if len(cut):
                    to = int(cut[-1])
                    break
                to = min(n, to + CHUNK_BYTES)
            s, e, h = _hash_span(raw[at:to], text_offsets[np.searchsorted(text_offsets, at) : np.searchsorted(text_offsets, to, "right")] - at)
            parts.append((s + at, e + at, h))
            at = to
        self.raw, self.text_offsets = raw, text_offsets
        self.starts, self.ends, self.hashes = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64 if i < 2 else np.uint64) for i in range(3))
        self.offsets = np.searchsorted(self.starts, text_offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.offsets[i] : self.offsets[i + 1]]


def text_chunks(texts: pa.Array):
    """(first row, row after the last, Words) for runs of rows of about CHUNK_BYTES; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def doc_index(offsets: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def shingles(w: Words, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words; of all its words if fewer; none without words."""
    h = w.hashes
    roll = np.zeros(len(h), np.uint64)
    for k in range(size):
        roll[: len(h) - k] = mix64(roll[: len(h) - k] * _U(0x9E3779B97F4A7C15) + h[k:] + _U(k + 1))
    out = []
    for i in range(len(w)):
        a, b = w.offsets[i], w.offsets[i + 1]
        if b - a >= size:
            out.append(np.unique(roll[a : b - size + 1]))
        elif b > a:
            v = _U(b - a)
            for x in h[a:b]:
                v = mix64(np.array([v], np.uint64) * _U(_BASE) + x)[0]
            out.append(np.array([v], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

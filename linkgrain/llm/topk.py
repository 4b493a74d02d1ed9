"""Operator 6: exact top-k search over an impact-ordered index, score at a time.

A block of vectors keeps, for each dimension, its postings in descending order
of impact, cut into segments of equal quantised impact.  A query takes the
segments of all dimensions in descending order of weight times impact and adds
them to accumulators.  What a dimension can still add is bounded by its next
segment, so every vector has a lower and an upper bound; when no more than a few
vectors reach the k-th lower bound, those are rescored exactly.  Without that
proof all segments are taken.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE = 256
LEVELS = 32
BLOCK_ROWS = 16_384
QUERY_ROWS = 2_048
#: Sums of whole numbers below this are exact in doubles.
EXACT = 1 << 53
LONG, MOST = (1 << 63) - 1, 10**38 - 1
#: A proof is looked for when so many parts of the segments are taken.
TESTS = (0.5, 0.8, 1.0)


class Block:
    """The postings of some integer vectors, in segments."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n, dims = self.vectors.shape
        self.postings, rows = [], []
        for d in range(dims if self.vectors.dtype != object else 0):
            v = self.vectors[:, d]
            width = max(1, -(-(int(v.max()) - int(v.min()) + 1) // LEVELS))
            level = (v - v.min()) // width
            by = np.argsort(-level, kind="stable").astype(np.int32)
            cuts = np.flatnonzero(np.diff(level[by])) + 1
            edges = np.concatenate([[0], cuts, [n]])
            self.postings.append(by)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                impact = v[by[a:b]]
                rows.append((d, a, b, int(impact.min()), int(impact.max())))
        self.segments = np.array(rows, np.int64).reshape(-1, 5)
        #: Below 2**53 doubles are exact; beyond, whole numbers of any size are.
        self.largest = max((abs(int(x)) for x in (self.vectors.max(), self.vectors.min())), default=0) if self.vectors.size else 0
        self.floats = self.vectors.astype(np.float64) if self.vectors.dtype != object else None
        self.lists = [self.postings[d][x:y] for d, x, y in self.segments[:, :3].tolist()]

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of the k best vectors but ``own``, ties to the smaller id, and the number of segments taken."""
        n = len(self.ids)
        others = np.flatnonzero(self.ids != own)
        k = min(k, len(others))
        if not k:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if self.largest * int(np.abs(query).max(initial=0)) * len(query) >= EXACT:
            return *self._top_of_all(query, others, k), len(self.segments)
        dim, a, b, low, high = self.segments.T
        weight = query[dim]
        # A negative weight takes the segments from their other end.
        least, most = np.where(weight >= 0, weight * low, weight * high), np.where(weight >= 0, weight * high, weight * low)
        order = np.argsort(-most, kind="stable")
        # A dimension adds at least its floor; accumulators hold what a vector's segments add beyond, for sure.
        floor = np.full(len(query), np.iinfo(np.int64).max)
        np.minimum.at(floor, dim, least)
        gain = (least - floor[dim]).astype(np.float64)
        slack = np.zeros(len(query), np.int64)
        np.maximum.at(slack, dim, most - least)
        acc = np.zeros(n)
        at = 0
        for part in TESTS:
            to = max(at, int(len(order) * part))
            take = [s for s in order[at:to].tolist() if gain[s]]
            if take:
                lists = [self.lists[s] for s in take]
                acc += np.bincount(np.concatenate(lists), np.repeat(gain[take], [len(x) for x in lists]), n)
            at = to
            # In each dimension a vector not met yet gains its next segment at most, one met its own segment's width.
            ahead = slack.copy()
            rest = order[at:]
            np.maximum.at(ahead, dim[rest], most[rest] - floor[dim[rest]])
            kth = np.partition(acc[others], len(others) - k)[len(others) - k]
            able = others[acc[others] + ahead.sum() >= kth]
            if len(able) <= max(64, 8 * k):
                break
        scores = (self.floats[able] @ query.astype(np.float64)).astype(np.int64)
        best = np.lexsort((self.ids[able], -scores))[:k]
        return scores[best], self.ids[able][best], at

    def _top_of_all(self, query: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``top`` by whole numbers of any size over all vectors, where sums may pass EXACT."""
        scores = self.vectors[others].astype(object) @ query.astype(object)
        best = sorted(range(len(others)), key=lambda i: (-scores[i], self.ids[others[i]]))[:k]
        return np.array([scores[i] for i in best], object), self.ids[others[best]]


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as floor(SCALE * x), whole numbers of any size where a long cannot hold them; shorter ones are filled with 0."""
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    # Doubles from 2**52 on are whole.
    if (np.abs(out) < EXACT / SCALE).all():
        return np.floor(out * SCALE).astype(np.int64)
    whole = [[int(x) * SCALE if abs(x) >= EXACT else math.floor(x * SCALE) for x in row] for row in out.tolist()]
    return np.array(whole, object).reshape(out.shape)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with a finite vector of doubles."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda x: x.cast("double")).alias("v"))


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """Of each row whose id is divisible by ``every`` the ``k`` rows of highest integer inner product: query_id, rank, vec_id, score.

    All other rows are candidates; ties go to the smaller id.  Candidates lie
    in blocks of about BLOCK_ROWS rows by a hash of id and vector, so equal
    vectors spread; each block meets the query set QUERY_ROWS queries at a time
    and gives k rows a query.  Nothing is broadcast or gathered but those.

    Rows with a null id or a null, or with a null or non-finite component, take
    no part; a vector shorter than another is filled with 0; rows with the
    query's id are its own, and an id with several vectors asks with each and
    gets the best rows of all; a table with one usable row, or none, gives no
    rows; other columns are not read.  Ranks go by exact products of up to 38
    digits, beyond which they are equal; a ``score`` that a long cannot hold is
    the nearest long.
    """
    rows = usable(vectors, id_col, vector_col)
    n = rows.count()
    n_blocks, n_queries = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n // every // QUERY_ROWS))
    spread = F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int")
    meets = F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))
    block = rows.select("vec_id", "v", spread.alias("block"), meets.alias("part"))
    asks = rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    asks = asks.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.pmod(F.xxhash64("vec_id"), F.lit(n_queries)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DecimalType(38, 0))])

    def run(key, left, right):
        none = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.decimal128(38))], names=schema.names)
        if not left.num_rows or not right.num_rows:
            return none
        dims = max(max(map(len, t[c].to_pylist())) for t, c in ((left, "v"), (right, "q")))
        data, asked = _matrix(left["v"], dims), _matrix(right["q"], dims)
        own = Block(left["vec_id"].to_numpy(), data)
        out: list[tuple[int, int, int]] = []
        for query_id, q in zip(right["query_id"].to_pylist(), asked, strict=True):
            scores, ids, _ = own.top(q, query_id, k)
            out += zip([query_id] * len(ids), ids.tolist(), (max(-MOST, min(MOST, x)) for x in scores.tolist()), strict=True)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int64(), pa.decimal128(38)), strict=True)], names=schema.names)

    parts = block.groupBy("block", "part").cogroup(asks.groupBy("block", "part")).applyInArrow(run, schema)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return parts.withColumn("rank", best.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.greatest(F.least("score", F.lit(LONG)), F.lit(-LONG - 1)).cast("long").alias("score"))

"""Operator 11: embedding whitening by hierarchical merging of singular value decompositions.

Every task keeps one sketch of its vectors: their number, exact sums, mean, and
the singular values times the right singular vectors of the centred vectors, all
of them.  Two sketches merge by stacking both with one row more, the difference
of the means times sqrt(n1 n2 / (n1 + n2)), and decomposing the stack again.
The squares of that row are what the common mean adds, so no dimension and no
variance is lost, and centring comes before any product.  Merging goes up a tree
of FAN sketches a node; a sketch has at most as many rows as dimensions, so no
task's memory follows the input.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written

FAN = 32
#: A component whose variance is a smaller part of the largest one's than this has none.
LEAST_VARIANCE = 1e-12
_SKETCH = "leaf long, n long, sums array<string>, mean array<double>, factor array<double>"
_MOMENTS = "leaf long, sums array<double>, products array<double>"


def quantised(vectors: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * entry) of every vector, entries as double, kept within a long; rows are all of one length."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    width = len(flat) // max(1, len(vectors))
    scaled = np.floor(scale * flat)
    inside = np.abs(scaled) < 2.0**63
    whole = np.where(inside, scaled, 0).astype(np.int64)
    whole[~inside] = np.where(scaled[~inside] > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min)
    return whole.reshape(len(vectors), width)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums in whole numbers of any size."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(w) for h, w in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


class Sketch:
    """Number, exact sums, mean and factor (singular values times right singular vectors) of vectors."""

    def __init__(self, n: int, sums: list[int], factor: np.ndarray):
        self.n, self.sums, self.factor = n, sums, factor
        self.mean = np.array([s / n for s in sums])

    @classmethod
    def of(cls, x: np.ndarray) -> Sketch:
        sums, n = exact_sums(x), len(x)
        mean = np.array([s / n for s in sums])
        return cls(n, sums, _decomposed(x - mean))

    def merged(self, other: Sketch) -> Sketch:
        n = self.n + other.n
        between = math.sqrt(self.n / n * other.n) * (self.mean - other.mean)
        return Sketch(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], _decomposed(np.vstack([self.factor, other.factor, between[None]])))


def _decomposed(rows: np.ndarray) -> np.ndarray:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def _packed(leaf: int, s: Sketch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([leaf], pa.int64()), pa.array([s.n], pa.int64()), pa.array([[str(v) for v in s.sums]], pa.list_(pa.string())), pa.array([s.mean], pa.list_(pa.float64())), pa.array([s.factor.ravel()], pa.list_(pa.float64()))],
        ["leaf", "n", "sums", "mean", "factor"],
    )


def _sketches(batches):
    for b in batches:
        for leaf, n, sums, factor in zip(b.column("leaf"), b.column("n"), b.column("sums"), b.column("factor"), strict=True):
            sums = [int(v) for v in sums.as_py()]
            yield leaf.as_py(), Sketch(n.as_py(), sums, np.asarray(factor.values, float).reshape(-1, len(sums)))


def _fold(batches):
    leaf, total = 0, None
    for k, s in _sketches(batches):
        leaf, total = (k, s) if total is None else (leaf, total.merged(s))
    if total is not None:
        yield _packed(leaf, total)


def _up_the_tree(parts: DataFrame, fold, schema: str) -> DataFrame:
    """One row of ``parts``, which have a ``leaf`` each, folded by FAN and more a node in the order of leaves."""
    left = parts.count()
    while left > FAN:
        left = math.ceil(left / FAN)
        parts = parts.repartition(left, F.floor(F.col("leaf") / FAN)).sortWithinPartitions("leaf").mapInArrow(fold, schema).withColumn("leaf", F.floor(F.col("leaf") / FAN))
    return parts.coalesce(1).sortWithinPartitions("leaf").mapInArrow(fold, schema)


class Whitening:
    """A fitted whitening: ``n``, exact ``sums``, ``mean``, ``variances`` (all), ``directions`` (rows; as many as asked)."""

    def __init__(self, sketch: Sketch, components: int):
        self.n, self.sums, self.mean = sketch.n, sketch.sums, sketch.mean
        _, s, v = np.linalg.svd(sketch.factor, full_matrices=False)
        width = len(self.mean)
        self.variances = np.concatenate([s * s / self.n, np.zeros(width - len(s))])
        keep = min(components, width)
        self.directions = v[:keep] if len(v) >= keep else np.vstack([v, np.zeros((keep - len(v), width))])
        # One sign for good: the largest entry is positive.
        signs = np.sign(self.directions[np.arange(keep), np.abs(self.directions).argmax(axis=1)]) if keep else np.zeros(0)
        self.directions = self.directions * np.where(signs == 0, 1, signs)[:, None]
        self.trace = float(self.variances.sum())
        self.live = self.variances[:keep] > LEAST_VARIANCE * max(self.variances[0] if width else 0, 0) if self.trace > 0 else np.zeros(keep, bool)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates; 0 along components without variance."""
        out = (x - self.mean) @ self.directions.T
        return np.divide(out, np.sqrt(np.where(self.live, self.variances[: len(self.live)], 1)), where=self.live[None], out=np.zeros_like(out))

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Exact sum over dimensions of (n x - sum)^2."""
        rough = float(self.n) ** 2 * ((x - self.mean) ** 2).sum(axis=1)
        if rough.max(initial=0) < 2.0**62 and self.n < 1 << 62:
            # Whole numbers modulo 2^64; the results are known to be smaller.
            sums = np.array([s % (1 << 64) for s in self.sums], np.uint64)
            d = x.astype(np.uint64) * np.uint64(self.n) - sums
            return (d * d).sum(axis=1).astype(np.int64)
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v): rows whose vector is present, not empty, and has neither null nor non-finite entries."""
    rows = table.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).filter(F.size("_v") > 0)
    return rows.filter(~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def fitted(rows: DataFrame, scale: float, components: int, block_rows: int = 4096) -> Whitening | None:
    """The whitening of all vectors of ``rows`` (_v); None without rows."""

    def sketched(batches):
        total = None
        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                part = Sketch.of(quantised(b.column(0).slice(at, block_rows), scale))
                total = part if total is None else total.merged(part)
        if total is not None:
            yield _packed(TaskContext.get().partitionId(), total)

    parts = written(rows.select("_v").mapInArrow(sketched, _SKETCH), "whiten-sketches")
    found = list(_sketches(_up_the_tree(parts, _fold, _SKETCH).toArrow().to_batches()))  # one row: dimensions squared
    released(parts)
    return Whitening(found[0][1], components) if found else None


def identity_error(rows: DataFrame, model: Whitening, scale: float) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, over components with variance; measured on all rows."""
    live = np.flatnonzero(model.live)

    def moments(batches):
        sums, products = np.zeros(len(live)), np.zeros((len(live), len(live)))
        for b in batches:
            w = model.project(quantised(b.column(0), scale))[:, live]
            sums += w.sum(axis=0)
            products += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sums], pa.list_(pa.float64())), pa.array([products.ravel()], pa.list_(pa.float64()))], ["leaf", "sums", "products"])

    def fold(batches):
        leaf, sums, products = None, 0, 0
        for b in batches:
            for k, s, p in zip(b.column("leaf"), b.column("sums"), b.column("products"), strict=True):
                leaf, sums, products = k.as_py() if leaf is None else leaf, sums + np.asarray(s.values, float), products + np.asarray(p.values, float)
        if leaf is not None:
            yield pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([sums], pa.list_(pa.float64())), pa.array([products], pa.list_(pa.float64()))], ["leaf", "sums", "products"])

    parts = written(rows.select("_v").mapInArrow(moments, _MOMENTS), "whiten-moments")
    total = _up_the_tree(parts, fold, _MOMENTS).first()
    released(parts)
    if not len(live) or total is None:
        return 0.0
    mean = np.array(total["sums"]) / model.n
    covariance = np.array(total["products"]).reshape(len(live), -1) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(len(live))).max())


def whitened(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, components: int = 32) -> DataFrame:
    """A row per usable vector: id, n, deviation (decimal), coordinates (array of double), explained (array), identity_error.

    Entries c become floor(scale * c), as the contract's x less its constant,
    which moves neither covariance nor deviation.  ``coordinates`` holds the
    vector's whitened coordinates by falling variance, ``explained`` each
    component's part of the whole variance, ``deviation`` the exact sum of
    (n x - S)^2, null beyond 38 digits.

    Defined results: vectors that are null, empty, or hold null, NaN or infinite
    entries take no part; of vectors of several lengths those of the commonest
    length do (ties: the longer).  Entries beyond a long count as the nearest
    one.  A component without variance (one row, equal rows, a constant
    dimension, fewer rows than components) has coordinate 0 and explains 0, and
    stays out of the identity's error.  Repeated rows count each, ids may be null
    or repeated, ties between variances leave their components in any order.  An
    empty table gives an empty table; other columns are not read.
    """
    rows = usable(table, id_col, vector_col)
    common = rows.groupBy(F.size("_v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    kind = dict(table.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n long, deviation decimal(38,0), coordinates array<double>, explained array<double>, identity_error double"
    if common is None:
        return table.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("_v") == common["width"])
    model = fitted(rows, scale, components)
    error = identity_error(rows, model, scale)
    share = np.where(model.live, model.variances[: len(model.live)] / (model.trace or 1), 0.0)

    def project(batches):
        for b in batches:
            x = quantised(b.column(1), scale)
            w = model.project(x)
            d = model.deviations(x)
            d = pa.array(d, pa.int64()).cast(pa.decimal128(38, 0)) if isinstance(d, np.ndarray) else pa.array([Decimal(v) if v < 10**38 else None for v in d], pa.decimal128(38, 0))
            offsets = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.ravel())) for v in (w, np.tile(share, (len(w), 1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(w), model.n)), d, *lists, pa.array(np.full(len(w), error))], [id_col, "n", "deviation", "coordinates", "explained", "identity_error"])

    return rows.select("_id", "_v").mapInArrow(project, schema)

"""Count vectors of fixed length, summed over the cluster.

Tasks hold one vector for each name and give it out in compressed blocks.  A
group of the first sum holds at most a WAYS-th of the tasks' blocks, one of the
second WAYS rows, so no task's memory follows the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

BLOCK = 1 << 14
WAYS = 64
SCHEMA = "name string, block int, way int, data binary"


def packed(vectors: dict[str, np.ndarray]):
    """Record batches of SCHEMA for the vectors (int64 sums, uint64 bit sets); empty blocks are left out."""
    way = TaskContext.get().partitionId() % WAYS
    for name, v in sorted(vectors.items()):
        for k in range(0, len(v), BLOCK):
            part = v[k : k + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k // BLOCK], pa.int32()), pa.array([way], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["name", "block", "way", "data"])


def _merge(table: pa.Table, bits: tuple[str, ...]) -> pa.Table:
    name, total = table["name"][0].as_py(), None
    for x in table["data"]:
        part = np.frombuffer(zlib.decompress(x.as_py()), np.uint64 if name in bits else np.int64)
        if total is None:
            total = part.copy()
        elif name in bits:
            total |= part
        else:
            total += part
    return pa.table({"name": table["name"].slice(0, 1), "block": table["block"].slice(0, 1), "way": pa.array([0], pa.int32()), "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def summed(parts: DataFrame, length: int, bits: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    """The vectors by name, ``length`` long each; those named in ``bits`` are united bit by bit."""

    def merge(table: pa.Table) -> pa.Table:
        return _merge(table, bits)

    rows = parts.groupBy("name", "block", "way").applyInArrow(merge, SCHEMA).groupBy("name", "block").applyInArrow(merge, SCHEMA)
    out: dict[str, np.ndarray] = {}
    for r in rows.toLocalIterator():  # at most length / BLOCK rows a name
        kind = np.uint64 if r["name"] in bits else np.int64
        v = out.setdefault(r["name"], np.zeros(length, kind))
        v[r["block"] * BLOCK : r["block"] * BLOCK + BLOCK] = np.frombuffer(zlib.decompress(r["data"]), kind)
    return out

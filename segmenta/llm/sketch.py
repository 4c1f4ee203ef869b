"""Counts of hashed features over a whole corpus, in a table of fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLOCK = 1 << 12


def count_sketch(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """How often each of ``2**bits`` slots (a hash's upper bits) is met. Each task sends its counts once, in blocks; sums are
    made in two levels, so no group grows with the number of tasks beyond a 64th of it."""

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            total += np.bincount((hashes(batch) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        blocks = [k for k in range(0, 1 << bits, _BLOCK) if total[k : k + _BLOCK].any()]
        salt = int(np.random.default_rng().integers(64))  # any will do: sums don't depend on it
        for a in range(0, len(blocks), 32):
            some = blocks[a : a + 32]
            yield pa.RecordBatch.from_arrays([pa.array([k // _BLOCK for k in some], pa.int32()), pa.array([salt] * len(some), pa.int32()), pa.array([zlib.compress(total[k : k + _BLOCK].tobytes(), 1) for k in some], pa.binary())], ["block", "salt", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_BLOCK, np.int64)
        for x in group.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        return pa.table({"block": group.column("block").slice(0, 1), "salt": pa.array([0], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    kinds = "block int, salt int, counts binary"
    sums = rows.mapInArrow(count, kinds).groupBy("block", "salt").applyInArrow(add, kinds).groupBy("block").applyInArrow(add, kinds)
    out = np.zeros(1 << bits, np.int64)
    for r in sums.select("block", F.col("counts")).toLocalIterator():  # 2**bits numbers in all
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return out

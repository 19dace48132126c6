"""Sums of large arrays over all tasks, made by Spark in blocks so that neither the driver nor one task holds them all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers in a block, and groups in which blocks are summed before the last sum.
BLOCK, LANES = 16_384, 64

ROWS = "block int, lane int, v binary"
ARROW = pa.schema([("block", pa.int32()), ("lane", pa.int32()), ("v", pa.binary())])


def blocks(total: np.ndarray, lanes: int = LANES, kind: type = np.float64) -> Iterator[pa.RecordBatch]:
    """A task's array as rows of blocks, for ROWS; kind: that of its numbers on their way."""
    from pyspark import TaskContext

    lane = TaskContext.get().partitionId() % lanes
    flat = np.ascontiguousarray(total, dtype=kind).ravel()
    parts = [flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([lane] * len(parts), pa.int32()), pa.array(parts, pa.binary())], schema=ARROW)


def _sum_of(kind: type) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(rows["v"].iloc[0], dtype=kind).astype(np.float64)
        for v in rows["v"].iloc[1:]:
            total += np.frombuffer(v, dtype=kind)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "lane": [0], "v": [total.tobytes()]})

    return add


def summed(rows: DataFrame, size: int, lanes: int = LANES, kind: type = np.float64) -> np.ndarray:
    """The sum of all tasks' arrays of `size` numbers; zeros if there was none. What reaches the driver is one such array.

    lanes, kind: as given to blocks(), sums are of doubles; with one lane the arrays are summed at once, for few tasks.
    """
    if lanes > 1:
        rows, kind = rows.groupBy("block", "lane").applyInPandas(_sum_of(kind), ROWS), np.float64
    total = np.zeros(size)
    for r in rows.groupBy("block").applyInPandas(_sum_of(kind), ROWS).collect():  # as an iterator, a job a partition
        v = np.frombuffer(bytes(r.v), dtype=np.float64)
        total[r.block * BLOCK : r.block * BLOCK + len(v)] = v
    return total

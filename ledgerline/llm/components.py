"""Connected components by contraction: every node moves to its least neighbour until few edges are left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import limit_batches, shared

#: As many edges at most are finished by one task; more are contracted by Spark first.
FEW = 100_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of a task: the root is the least node."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    ends = pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]).combine_chunks().dictionary_encode()
    names = ends.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), dtype=np.int64)
    rank[order] = np.arange(len(names))
    a, b = rank[ends.indices.to_numpy()].reshape(2, -1)
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    kind = t.schema.field(0).type
    yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in order], kind), pa.array([names[order[find(k)]] for k in range(len(order))], kind)], names=["node", "root"])


def components(edges: DataFrame, *, few: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nulls are in none.

    Nodes should be hashes: then a round leaves a fraction of the edges whatever the graph's shape, and a node with very
    many neighbours costs no more than its edges, whose minimum is taken before the shuffle. Rounds go on until there are
    `few` edges, which one task can hold.
    """
    limit_batches(edges.sparkSession)
    few = FEW if few is None else few
    kind = edges.schema["a"].dataType.simpleString()
    left, steps = shared(edges.where("a <> b").selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct()), []
    while n := left.count():
        if n <= few:
            steps.append(shared(left.coalesce(1).mapInArrow(_finish, f"node {kind}, root {kind}")))
            break
        near = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        step = shared(near.select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        steps.append(step)
        moved = left.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        left = shared(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not steps:
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    found = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("to"))
        found = found.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return found

"""Centroid clustering over space-filling-curve zone maps.

Vectors are dealt by ranges of their place on a Hilbert curve and cut into blocks, each with the least and greatest value
of every component. The box bounds the distance of all its vectors to a centroid from below and from above, so that a
block is compared, exactly and at once, with those centroids alone that may be the nearest of one of its vectors. Blocks
are written once; a round reads them, and what it gathers is a sum and a count for each centroid.

All numbers are whole: the result depends on no order of additions and on no partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import counted_memory, limit_batches, shared
from ledgerline.llm.cover_tree import whole_numbers

#: Vectors in a block, and bits of a component's place on the grid of the curve; only the speed depends on them.
BLOCK, BITS = 128, 4
#: The largest absolute component: squared distances of 64 components then fit 64 bits. Beyond it the query fails.
LARGEST = 1 << 27
#: Up to this absolute component, squared distances are exact in double precision.
EXACT = 1 << 20


def hilbert_keys(grid: np.ndarray, bits: int = BITS) -> list[bytes]:
    """The place on the Hilbert curve of each row of a grid of numbers below 2**bits, as bytes in the curve's order."""
    axes = np.ascontiguousarray(grid.T.astype(np.uint8))
    for level in range(bits - 1, 0, -1):  # turn and mirror each axis as its higher bits ask, coarse to fine
        low = np.uint8((1 << level) - 1)
        for i in range(len(axes)):
            mirrored = (axes[i] >> level & 1).astype(bool)
            swap = np.where(mirrored, 0, (axes[0] ^ axes[i]) & low)
            axes[i] ^= swap
            axes[0] ^= np.where(mirrored, low, swap)
    axes = np.bitwise_xor.accumulate(axes, axis=0)
    turn = np.zeros(axes.shape[1], dtype=np.uint8)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] >> level & 1, np.uint8((1 << level) - 1), np.uint8(0))
    axes ^= turn
    spread = [(axes >> level & 1).T for level in range(bits - 1, -1, -1)]
    return [row.tobytes() for row in np.packbits(np.concatenate(spread, axis=1), axis=1)]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dims)


def _bounds(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each component; a row a component reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dims, np.iinfo(np.int64).max), np.full(dims, np.iinfo(np.int64).min)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dims)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(low), pa.array(high)], names=["k", "low", "high"])

    rows = vectors.select("v").mapInArrow(run, "k int, low long, high long").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("k").collect()
    return np.array([r.low for r in rows]), np.array([r.high for r in rows])


def zone_maps(vectors: DataFrame, dims: int, low: np.ndarray, high: np.ndarray, *, size: int = BLOCK) -> DataFrame:
    """(ids array<long>, points binary, low binary, high binary): vectors id, v in blocks along the curve, written once.

    Rows of equal vectors, however many, are dealt over as many ranges as they fill: their number in the input decides.
    """
    step = np.maximum(high - low + 1, 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dims)
            keys = hilbert_keys((x - low) * (1 << BITS) // step) if b.num_rows else []
            points = pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), points, pa.array(keys, pa.binary()), b.column(2)], names=["id", "p", "key", "salt"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with counted_memory():
            ids, points = [], []

            def block(n: int) -> pa.RecordBatch:
                x = np.frombuffer(b"".join(points[:n]), dtype="<i4").reshape(n, dims)
                made = [pa.array([ids[:n]], pa.list_(pa.int64())), *(pa.array([m.tobytes()], pa.binary()) for m in (x, x.min(axis=0), x.max(axis=0)))]
                del ids[:n], points[:n]
                return pa.RecordBatch.from_arrays(made, names=["ids", "points", "low", "high"])

            for b in batches:
                ids += b.column(0).to_pylist()
                points += b.column(1).to_pylist()
                while len(ids) >= size:
                    yield block(size)
            if ids:
                yield block(len(ids))

    # numbered where it is read, so that a task that is run again gives the same rows the same numbers
    placed = vectors.select("id", "v", F.monotonically_increasing_id().alias("salt")).mapInArrow(place, "id long, p binary, key binary, salt long")
    dealt = placed.repartitionByRange("key", "salt").sortWithinPartitions("key", "salt")
    return shared(dealt.select("id", "p").mapInArrow(pack, "ids array<long>, points binary, low binary, high binary"))


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be the nearest of a vector within a box: all but those whose least distance to
    it exceeds another's greatest."""
    below, above = low - centroids, centroids - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
    return np.flatnonzero(least <= most.min())


def nearest(x: np.ndarray, centroids: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centroid of each vector, the smaller of equal ones, and the squared distance."""
    if exact:
        x, c = x.astype(np.float64), centroids.astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    else:
        d = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at].astype(np.int64)


def _assigned(batches: Iterator[pa.RecordBatch], dims: int, centroids: np.ndarray, exact: bool) -> Iterator[tuple[pa.ListScalar, np.ndarray, np.ndarray, np.ndarray, int]]:
    """ids, vectors, clusters, distances and number of candidates of each block."""
    for b in batches:
        for ids, *raw in zip(*b.columns, strict=True):
            x, low, high = (np.frombuffer(r.as_py(), dtype="<i4").astype(np.int64) for r in raw)
            x = x.reshape(-1, dims)
            some = candidates(low, high, centroids)
            at, distance = nearest(x, centroids[some], exact)
            yield ids, x, some[at], distance, len(some)


def _sums(blocks: DataFrame, dims: int, centroids: np.ndarray, exact: bool) -> tuple[list[int], list[int], list[list[int]], float]:
    """Count, sum of distances and sum of vectors of each cluster, and the share of centroids that were compared.

    A task's sums are k rows for every component; Spark adds them up, and the driver gets one number for each.
    """
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((k, dims + 2), dtype=np.int64), [0, 0]
        with counted_memory():
            for _, x, cluster, distance, compared in _assigned(batches, dims, centroids, exact):
                np.add.at(total, cluster, np.column_stack([x, np.ones(len(x), dtype=np.int64), distance]))
                met = [met[0] + compared, met[1] + k]
        at = [*range(k * (dims + 2)), -1, -2]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([*total.ravel().tolist(), *met], pa.int64())], names=["at", "s"])

    rows = {r.at: r.s for r in blocks.mapInArrow(run, "at int, s long").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    wide = [[rows.get(j * (dims + 2) + i, 0) for i in range(dims + 2)] for j in range(k)]
    return [w[dims] for w in wide], [w[dims + 1] for w in wide], [w[:dims] for w in wide], rows.get(-1, 0) / max(rows.get(-2, 0), 1)


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding", seed: str = "1:", report: Callable[[float], None] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid: each vector's nearest of k centroids after the rounds.

    Components are taken as floor(scale * x); vectors null, of another number of components or with a null or non-finite
    one take no part. The first centroids are the k vectors whose ids, written after `seed`, have the least sha256; a null
    id comes last, equal ids in order of their vectors. Fewer vectors give fewer centroids, none give no rows. Rows that
    repeat are vectors like all others. A component beyond LARGEST fails the query. Only the columns named are read, so no
    other column clashes. report gets the share of (block, centroid) pairs that was compared in each pass.
    """
    spark = vectors.sparkSession
    limit_batches(spark)
    whole = vectors.select(F.col(vec_id).cast("long").alias("id"), F.when(F.size(vector) == dims, F.col(vector)).alias("w"))
    fits = ~F.exists("w", lambda x: F.abs(x.cast("double")) > LARGEST / scale)
    checked = F.when(fits, F.col("w")).otherwise(F.raise_error(F.lit("a component is too large to be clustered")))
    good = ~F.exists("w", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = whole.where(F.col("w").isNotNull() & good).select("id", checked.alias("w")).select("id", whole_numbers("w", scale).alias("v"))
    first = kept.select("v", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h"), "id").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    shape = "vec_id long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{shape}, cluster_inertia long, inertia long, centroid array<long>")
    centroids = np.array([r.v for r in first], dtype=np.int64)
    low, high = _bounds(kept, dims)
    exact = int(max(-low.min(), high.max())) <= EXACT
    blocks = zone_maps(kept, dims, low, high)
    tell = report or (lambda share: None)
    for _ in range(rounds):
        counts, _, sums, share = _sums(blocks, dims, centroids, exact)
        centroids = np.array([[s // n for s in own] if n else c.tolist() for own, n, c in zip(sums, counts, centroids, strict=True)], dtype=np.int64)
        tell(share)
    _, inertia, _, share = _sums(blocks, dims, centroids, exact)
    tell(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with counted_memory():
            for ids, _, own, distance, _ in _assigned(batches, dims, centroids, exact):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(own, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    of = lambda values: F.array(*(F.lit(v).cast("long") for v in values))[F.col("cluster")]
    centres = F.array(*(F.array(*(F.lit(int(v)).cast("long") for v in c)) for c in centroids))[F.col("cluster")]
    return blocks.mapInArrow(run, shape).select("*", of(inertia).alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), centres.alias("centroid"))

"""Exact top-k inner-product search with cover trees over queries and data together.

Vectors are dealt to cells around far-apart centres, the top of the tree, and cells to chunks of bounded size by a hash
of the id, so that a very common vector fills several chunks. Each chunk becomes one packed row with its own cover tree;
so does each block of queries. A pair of nodes is left out if the largest inner product that their centres and covering
radii allow lies below the worst kth score in the query node.

Every block of queries first meets the cell that allows the largest inner product. The kth scores found there travel
with the block, which then meets only those other cells that allow as much as the worst of them. Every chunk gives at
most k rows a query; Spark merges them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import limit_batches, shared

#: Vectors in a chunk and queries in a block, about; cells at most; blocks that meet a chunk in one task.
CHUNK, BLOCK, CELLS, LOT = 8192, 256, 256, 64
#: Rows among which the cells' centres are chosen; only the shape of the cells depends on it, not the result.
SAMPLE = 2048
#: Points in a leaf; a node that more children than these would have to cover at half its radius is a leaf too.
LEAF, FANOUT = 64, 64


def whole_numbers(vector: str, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, null for a vector that is null or holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class CoverTree:
    """Nodes over contiguous ranges of points; a node's radius covers its points from its centre, which is one of them.

    The children of a node cover its points at half its radius, and their centres are further apart than that.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        x = points.astype(np.float64)
        self.start, self.end, self.centre, self.radius, self.children = [], [], [], [], []
        stack = [(0, len(points), -1)]
        while stack:
            a, b, parent = stack.pop()
            own = self.order[a:b]
            away = np.linalg.norm(x[own] - x[own[0]], axis=1)
            radius, me = float(away.max()), len(self.start)
            self.start.append(a)
            self.end.append(b)
            self.centre.append(int(own[0]))
            self.radius.append(radius)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            if b - a <= LEAF or radius == 0:
                continue
            # centres more than half the radius apart; each point goes to the nearest
            near, to = away.copy(), np.zeros(b - a, dtype=np.int64)
            for k in range(1, FANOUT + 1):
                far = int(near.argmax())
                if near[far] <= radius / 2 or k == FANOUT:
                    break
                d = np.linalg.norm(x[own] - x[own[far]], axis=1)
                closer = d < near
                near[closer], to[closer] = d[closer], k
            if near.max() > radius / 2:
                continue
            # the node's own centre stays first in its part, and so does each other one
            by = np.lexsort((near, to))
            self.order[a:b] = own[by]
            cuts = np.flatnonzero(np.diff(to[by])) + 1
            stack += [(a + int(s), a + int(e), me) for s, e in zip(np.r_[0, cuts], np.r_[cuts, b - a], strict=True)]


class Chunk:
    """(id, vector) rows in tree order."""

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        self.tree = CoverTree(points)
        self.ids, self.points = ids[self.tree.order], points[self.tree.order]
        self.real = self.points.astype(np.float64)
        t = self.tree
        self.centres = points[t.centre].astype(np.float64)
        self.norms, self.radius = np.linalg.norm(self.centres, axis=1), np.array(t.radius)


def products(q: np.ndarray, x: np.ndarray, q_real: np.ndarray, x_real: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where its 53 bits are enough. Products that 64 bits can't hold are an error."""
    most = float(np.abs(q_real).max(initial=0)) * float(np.abs(x_real).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return (q_real @ x_real.T).astype(np.int64)
    if most < 2**63:
        return q @ x.T
    exact = q.astype(object) @ x.astype(object).T
    if exact.size and not -(2**63) < min(exact.flat) <= max(exact.flat) < 2**63:
        raise OverflowError("an inner product doesn't fit 64 bits")
    return exact.astype(np.int64)


_LEAST = np.iinfo(np.int64).min
_NO_ID = np.iinfo(np.int64).max


def largest(q: np.ndarray, q_radius: float, x: np.ndarray, x_radius: np.ndarray) -> np.ndarray:
    """The largest inner products of points within q_radius of q and points within x_radius of each x."""
    top = x @ q + np.linalg.norm(q) * x_radius + np.linalg.norm(x, axis=-1) * q_radius + q_radius * x_radius
    return top + 1e-6 * (1 + np.abs(top))


def search(q: Chunk, x: Chunk, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of x for each row of q, best first; _NO_ID where there are fewer.

    least: kth scores of each row of q known from elsewhere; rows of lower scores need not be found.
    """
    ids = np.full((len(q.ids), k), _NO_ID)
    scores = np.full((len(q.ids), k), _LEAST)
    least = np.full(len(q.ids), _LEAST) if least is None else least

    def bound(a: int, b: int | np.ndarray) -> np.ndarray:
        return largest(q.centres[a], q.radius[a], x.centres[b], x.radius[b])

    stack = [(0, 0, float("inf"))]
    while stack:
        a, b, top = stack.pop()
        own = slice(q.tree.start[a], q.tree.end[a])
        if top < np.maximum(scores[own, -1], least[own]).min():
            continue
        down_q, down_x = q.tree.children[a], x.tree.children[b]
        if down_x and (not down_q or x.radius[b] >= q.radius[a]):
            tops = bound(a, np.array(down_x))
            stack += [(a, down_x[i], tops[i]) for i in np.argsort(tops)]  # the most promising is taken first
        elif down_q:
            stack += [(c, b, float(bound(c, b))) for c in down_q]
        else:
            them = slice(x.tree.start[b], x.tree.end[b])
            for low in range(them.start, them.stop, 1024):
                part = slice(low, min(low + 1024, them.stop))
                found = products(q.points[own], x.points[part], q.real[own], x.real[part])
                named = np.broadcast_to(x.ids[part], found.shape)
                self_ = named == q.ids[own][:, None]
                live = np.flatnonzero(((found >= np.maximum(scores[own, -1], least[own])[:, None]) & ~self_).any(axis=1))
                if not len(live):
                    continue
                rows = live + own.start
                s = np.concatenate([scores[rows], np.where(self_[live], _LEAST, found[live])], axis=1)
                n = np.concatenate([ids[rows], np.where(self_[live], _NO_ID, named[live])], axis=1)
                best = np.lexsort((n, -np.maximum(s, _LEAST + 1)), axis=1)[:, :k]
                scores[rows], ids[rows] = np.take_along_axis(s, best, axis=1), np.take_along_axis(n, best, axis=1)
    return ids, scores


def _far_apart(rows: list, cells: int) -> dict[int, np.ndarray]:
    """By dimension, centres chosen far from each other among the sampled rows."""
    out = {}
    for dim in {len(r) for r in rows}:
        x = np.array([r for r in rows if len(r) == dim], dtype=np.float64).reshape(-1, dim)
        chosen = [0]
        near = np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < cells and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
        out[dim] = x[chosen]
    return out


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """One row of the rows of a chunk, with its tree."""
    x = np.stack(rows["v"].to_numpy()).astype(np.int64).reshape(len(rows), -1)
    order = np.argsort(rows["id"].to_numpy(dtype=np.int64), kind="stable")
    chunk = Chunk(rows["id"].to_numpy(dtype=np.int64)[order], x[order])
    chunk.real = None  # made again when it is needed
    return pd.DataFrame({"no": rows["no"].iloc[:1], "dim": [x.shape[1]], "n": [len(x)], "packed": [pickle.dumps(chunk)]})


def _unpacked(raw: bytes) -> Chunk:
    chunk = pickle.loads(raw)  # noqa: S301  what _packed has written
    chunk.real = chunk.points.astype(np.float64)
    return chunk


def top_k(vectors: DataFrame, queries: Column, *, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row for which `queries` holds.

    Scores are inner products of whole_numbers(); one that 64 bits can't hold fails the query. Rows of a query's own id
    are no candidates of it; ties go to the smaller id; rows of a null id, a null vector, an empty one or one of another
    length take no part. Rows that repeat are rows: each is a candidate, and each that asks gets its own k. An empty
    table, or one without queries, gives no rows; other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    limit_batches(spark)
    clean = vectors.select(F.col(vec_id).cast("long").alias("id"), whole_numbers(vector, scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    )
    cells = max(1, min(CELLS, -(-clean.count() // CHUNK)))
    centres = spark.sparkContext.broadcast(_far_apart([r.v for r in clean.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").collect()], cells))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, cell, away = b.column(1), np.zeros(b.num_rows, dtype=np.int32), np.zeros(b.num_rows)
            dims = np.diff(np.asarray(lists.offsets))
            values = np.asarray(lists.values, dtype=np.float64)[int(lists.offsets[0].as_py()) :]
            ends = np.r_[0, np.cumsum(dims)]
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x, c = values[ends[rows][:, None] + np.arange(dim)], centres.value.get(int(dim), np.zeros((1, dim)))
                cell[rows] = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
                away[rows] = np.linalg.norm(x - c[cell[rows]], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(away)], names=["id", "v", "asks", "cell", "away"])

    dealt = shared(clean.mapInArrow(assign, "id long, v array<long>, asks boolean, cell int, away double").withColumn("dim", F.size("v")))
    counts = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if("asks").alias("m"), F.max("away").alias("away")).orderBy("dim", "cell").collect()  # a row for each cell

    def packed(rows: DataFrame, count: str, size: int) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
        """The rows in numbered chunks of about `size`; of each cell with rows its dimension, number, first chunk and chunks."""
        first, at = [], 0
        for r in counts:
            if r[count]:
                first.append((r.dim, r.cell, at, -(-r[count] // size)))
                at += first[-1][-1]
        numbers = F.broadcast(spark.createDataFrame(first, "dim int, cell int, first int, parts int"))
        placed = rows.join(numbers, ["dim", "cell"]).select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("no"), "id", "v")
        return shared(placed.groupBy("no").applyInPandas(_packed, "no int, dim int, n int, packed binary")), first

    data, chunks = packed(dealt.drop("asks"), "n", CHUNK)
    asking, _ = packed(dealt.where("asks").drop("asks"), "m", BLOCK)
    away = {(r.dim, r.cell): r.away for r in counts}

    def cells_of(q: Chunk, dim: int, known: list[dict] | None) -> list[int]:
        """Without kth scores, the cell nearest to the block's queries; with them, all other cells that allow a query as much as its own."""
        own = np.array([c for d, c, _, _ in chunks if d == dim])
        x, points = centres.value.get(dim, np.zeros((1, dim)))[own], q.points.astype(np.float64)
        nearest = int((x @ points.mean(axis=0)).argmax())
        if known is None:
            return [int(own[nearest])]
        least, radius = np.full(len(points), -np.inf), np.array([away[dim, c] for c in own.tolist()])
        least[[r["at"] for r in known]] = [r["score"] for r in known]
        asks = np.any([largest(p, 0.0, x, radius) >= m for p, m in zip(points, least, strict=True)], axis=0)
        asks[nearest] = False
        return own[asks].tolist()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("packed", "dim", "known", "seed")), strict=True)
            found = [cells_of(pickle.loads(raw), dim, None if seed else known or []) for raw, dim, known, seed in rows]  # noqa: S301
            yield pa.RecordBatch.from_arrays([b.column("no"), b.column("dim"), pa.array(found, pa.list_(pa.int32()))], names=["no", "dim", "cells"])

    def pairs(known: DataFrame, seed: bool) -> DataFrame:
        rows = asking.join(known, "no", "left").withColumn("seed", F.lit(seed)).mapInArrow(choose, "no int, dim int, cells array<int>")
        return shared(rows.select("no", "dim", F.explode("cells").alias("cell")))

    where = F.broadcast(spark.createDataFrame(chunks, "dim int, cell int, first int, parts int"))
    result = "query_id long, asked long, vec_id long, score long"

    def meet(blocks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for c in held.itertuples():
            x = _unpacked(c.packed)
            for b in blocks.itertuples():
                q = _unpacked(b.packed)
                least = np.full(len(q.ids), _LEAST)
                if b.known is not None and len(b.known):
                    least[[r["at"] for r in b.known]] = [r["score"] for r in b.known]
                ids, scores = search(q, x, k, least)
                live = ids != _NO_ID
                row = np.nonzero(live)[0]
                parts.append(pd.DataFrame({"query_id": q.ids[row], "asked": (b.no << 32) + row, "vec_id": ids[live], "score": scores[live]}))
        return pd.concat(parts) if parts else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "asked", "vec_id", "score")})

    def met(pairs: DataFrame, known: DataFrame) -> DataFrame:
        """What the blocks find in the chunks of the cells they are paired with."""
        chunk = pairs.join(where, ["dim", "cell"]).select("no", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("chunk"), F.floor(F.col("no") / LOT).cast("int").alias("lot"))
        left = chunk.join(asking.select("no", "packed"), "no").join(known, "no", "left")
        right = chunk.select(F.col("chunk").alias("held"), F.col("lot").alias("by")).distinct().join(data.select(F.col("no").alias("held"), "packed"), "held")
        return left.groupBy("chunk", "lot").cogroup(right.groupBy("held", "by")).applyInPandas(meet, result)

    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    nothing = spark.createDataFrame([], "no int, known array<struct<at:int,score:bigint>>")
    first = shared(met(pairs(nothing, True), nothing).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    kth = first.where(F.col("rank") == k).select(F.shiftright("asked", 32).cast("int").alias("no"), F.struct(F.col("asked").bitwiseAND(0xFFFFFFFF).cast("int").alias("at"), "score").alias("r"))
    known = shared(kth.groupBy("no").agg(F.collect_list("r").alias("known")))  # one for each query of a block
    found = first.drop("rank").union(met(pairs(known, False), known))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

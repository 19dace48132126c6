"""Jaccard self-join of documents on word n-grams, by an LSH forest of MinHash prefix tries.

Texts of equal n-gram sets are one class of copies. Each class gets a MinHash signature, cut into the paths of several
tries; a path is one number, a byte a level, so that sorted paths are a sorted trie. Sets that share a node, a prefix of
a path, are compared by whole signatures; those that may be alike are joined to clusters, and all pairs of a cluster are
compared exactly. The search begins with whole paths. The exact comparison then tells how many links near the threshold
such prefixes miss, and prefixes are shortened by a level until the recall measured in this way reaches its target.

Exact comparison is in blocks of bounded size, whose tasks emit counts of links and a spanning forest, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import limit_batches, map_rows, shared, words_of
from ledgerline.llm.components import components

#: A path of LONGEST bytes is one 64-bit number.
TREES, LONGEST, RECALL = 20, 8, 0.995
#: Classes and n-grams in a block of an exact comparison, about, and sets in a block of a trie node.
BLOCK_ROWS, BLOCK_GRAMS, NODE_ROWS = 512, 400_000, 1024
#: Sets that share a node are joined if their signatures agree in so much less than the similarity: six deviations.
SLACK = 0.2
#: Slots of the filter that keeps most texts out of the exact comparison before they are moved; it has a row a slot at most.
SLOTS = 1 << 20
#: Recall is measured on links of a similarity less than this above the threshold.
BAND = 0.05
_KEPT_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def share_node(similarity: float | np.ndarray, depth: int, trees: int) -> float | np.ndarray:
    """The probability that two sets of this similarity share a node at this depth of some trie."""
    return 1 - (1 - similarity**depth) ** trees


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Grams:
    """Sorted distinct n-gram hashes of texts; keeps the hashes of words."""

    def __init__(self, n: int) -> None:
        self.n, self.known = n, {}
        self.odd = [np.uint64(x) for x in (mixed(np.arange(1, n + 1, dtype=np.uint64) * _MIX) | np.uint64(1)).tolist()]

    def of(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """A text of fewer than n words, but not none, has one n-gram, all its words."""
        words = [words_of(t) for t in texts]
        if len(self.known) > _KEPT_WORDS:
            self.known = {}
        self.known.update((w, int.from_bytes(blake2b(w, digest_size=8).digest(), "little")) for w in set().union(*words).difference(self.known))
        of = self.known.__getitem__
        for ws in words:
            h = np.fromiter(map(of, ws), dtype=np.uint64, count=len(ws))
            m = min(self.n, len(h))
            if not m:
                yield h
                continue
            size = len(h) - m + 1
            out = np.full(size, m, dtype=np.uint64)
            for k in range(m):
                out += h[k : k + size] * self.odd[k]
            yield np.unique(mixed(out))


class Forest:
    """MinHash paths of a set of hashes: one number for each trie, a byte for each level, the first the highest."""

    def __init__(self, trees: int) -> None:
        rng = np.random.default_rng(4)
        self.trees = trees
        self.times = rng.integers(0, 1 << 63, trees * LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, trees * LONGEST, dtype=np.uint64)

    def paths(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.times), np.iinfo(np.uint64).max, dtype=np.uint64)
        for low in range(0, len(grams), 512):
            np.minimum(least, (self.times[:, None] * grams[None, low : low + 512] + self.plus[:, None]).min(axis=1), out=least)
        return (mixed(least) >> np.uint64(56)).astype(np.uint8).view(">i8").astype(np.int64)


def alike(group: np.ndarray, side: np.ndarray, cross: np.ndarray, paths: np.ndarray, least: float) -> np.ndarray:
    """For rows sorted by group, the place of a row of the same group that chains of alike rows lead to, often the row's own.

    Rows are alike if at least this share of their signatures' bytes agrees. In a group that is `cross` only rows of
    different sides are compared. Neighbours are compared first: rows already joined need no comparison any more.
    """
    n = len(group)
    root, label = list(range(n)), np.arange(n)
    need, width = int(np.ceil(least * paths.shape[1] * LONGEST)), max(1, (1 << 16) // max(1, paths.shape[1]))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for step in range(1, n):
        i = np.flatnonzero(group[:-step] == group[step:])
        if not len(i):
            break
        i = i[(label[i] != label[i + step]) & (~cross[i] | (side[i] != side[i + step]))]
        met = False
        for low in range(0, len(i), width):
            part = i[low : low + width]
            same = ((paths[part] ^ paths[part + step]).view(np.uint8) == 0).sum(axis=1)
            for k in part[same >= need].tolist():
                a, b = sorted((find(k), find(k + step)))
                root[b], met = a, True
        if met:
            label = np.array([find(k) for k in range(n)])
    return label


def join_nodes(least: float):
    """A function over rows (node, low, high, block, set, paths), sorted by the first three and the path: edges of a forest of alike sets."""

    def edges(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        node, low, high, block = (t.column(k).to_numpy() for k in range(4))
        starts = np.r_[True, (node[1:] != node[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
        paths = t.column(5).combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        label = alike(np.cumsum(starts), block, low != high, paths, least)
        own = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([t.column(4).take(pa.array(x)).combine_chunks() for x in (own, label[own])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if held and n >= NODE_ROWS:  # cut where a group ends
                key = [b.column(k).to_numpy() for k in range(3)]
                last = [held[-1].column(k)[-1].as_py() for k in range(3)]
                goes_on = (key[0] == last[0]) & (key[1] == last[1]) & (key[2] == last[2])
                m = int(goes_on.argmin()) if not goes_on.all() else len(goes_on)
                if m:
                    held.append(b.slice(0, m))
                    b = b.slice(m)
                if b.num_rows:
                    yield edges(held)
                    held, n = [], 0
            if b.num_rows:
                held.append(b)
                n += b.num_rows
        if held:
            yield edges(held)

    return run


def linked(x: np.ndarray, ends: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sets, lying one after another in x, are similar: a square matrix without its diagonal. And their similarities."""
    n, sizes = len(ends) - 1, np.diff(ends)
    grams, place, times = np.unique(x, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    live = (times > 1)[place]
    row, col = np.repeat(np.arange(n), sizes)[live], column[place[live]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((n, n), dtype=np.float32)
    width = max(256, min(4096, (1 << 22) // max(n, 1)))
    for low in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, (low, low + width))
        block = np.zeros((n, width), dtype=np.float32)
        block[row[a:b], col[a:b] - low] = 1
        both += block @ block.T
    union = sizes[:, None] + sizes[None, :] - both
    out = both >= similarity * union - 1e-6
    np.fill_diagonal(out, False)
    return out, both / union


def compare(similarity: float, trees: int):
    """A function over rows sorted by (cluster, low, high): exact links of each block pair.

    near: links of a similarity close to the threshold; met: for each depth how many such links there should be by those
    found, each counted by the inverse of its probability to share a node at that depth.
    """

    names = ["cluster", "set", "root", "links", "near", "met"]

    def group(cluster: bytes, sets: list[bytes], blocks: list[int], copies: list[int], grams: list[np.ndarray], cross: bool) -> pa.RecordBatch:
        x, s = linked(np.concatenate(grams), np.r_[0, np.cumsum([len(g) for g in grams])], similarity)
        if cross:
            side = np.array(blocks)
            x &= side[:, None] != side[None, :]
        root = np.arange(len(sets))
        while True:
            least = np.minimum(root, np.where(x, root[None, :], len(sets)).min(axis=1))
            least = least[least]
            if (least == root).all():
                break
            root = least
        links = x @ np.array(copies, dtype=np.float64)
        band = x & (s < similarity + BAND)
        rows, cols = np.nonzero(band)
        met = [np.bincount(rows, 1 / share_node(s[rows, cols].astype(np.float64), d, trees), minlength=len(sets)) for d in range(1, LONGEST + 1)]
        at = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays(
            [pa.array([cluster] * len(at), pa.binary()), pa.array([sets[i] for i in at], pa.binary()), pa.array([sets[root[i]] for i in at], pa.binary()), pa.array(links[at].astype(np.int64)), pa.array(band.sum(axis=1)[at].astype(np.int64)), pa.array(list(np.stack(met, axis=1)[at]), pa.list_(pa.float64()))],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])
        for b in batches:
            clusters, lows, highs = (b.column(i).to_pylist() for i in range(3))
            for i, at in enumerate(zip(clusters, lows, highs, strict=True)):
                if at != key:
                    if len(held[0]) > 1:
                        yield group(key[0], *held, key[1] != key[2])
                    key, held = at, ([], [], [], [])
                held[0].append(b.column(3)[i].as_py())
                held[1].append(b.column(4)[i].as_py())
                held[2].append(b.column(5)[i].as_py())
                held[3].append(np.frombuffer(b.column(6)[i].as_buffer(), dtype=np.uint64).copy())
        if len(held[0]) > 1:
            yield group(key[0], *held, key[1] != key[2])

    return run


def row_key(doc_id: str, text: str) -> Column:
    """A number for id and text, nulls told apart from empty ones."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))


def trie_edges(sets: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(a, b): a forest over the sets that share a node at this depth of some trie and whose signatures are alike."""
    shift = 8 * (LONGEST - depth)
    paths = sets.select("set", F.posexplode("paths").alias("tree", "path")).select("set", "path", F.xxhash64("tree", F.shiftrightunsigned("path", shift)).alias("node"))
    hubs = paths.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.ceil(F.col("n") / NODE_ROWS).cast("int").alias("parts"))
    met = paths.join(hubs, "node").join(sets.select("set", "paths"), "set").withColumn("block", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))
    pairs = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("node", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "set", "paths", "path")
    ordered = pairs.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high", "path", "set").drop("path")
    return ordered.mapInArrow(join_nodes(similarity - SLACK), "a binary, b binary")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, similarity: float = 0.8, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: its id, class_id, copy_id, n_copies, n_links, keep_key; other columns are left out.

    copy_id: least id among the texts of the same n-gram set, n_copies their number. n_links: rows whose set is at least
    `similarity` alike, copies included, the row itself not. class_id: least id among all that links join, directly or
    by others. keep_key: row_key(id, text) of the class's row of least id, the same for all its rows. Texts of fewer
    than n words have one n-gram; a text without words, null included, is a class of its own with 0 links. Rows may
    repeat: they are copies. Null ids are no class id unless the class has no other. Ties of ids go to the least key. An
    empty table gives an empty one. Texts are taken whole, however long.
    """
    limit_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row_key(doc_id, text).alias("key"))

    def sketch():
        grams, forest = Grams(n), Forest(trees)

        def work(texts):
            out = ([], [], [])
            for g in grams.of(texts):
                out[0].append(blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None)
                out[1].append(len(g))
                out[2].append(forest.paths(g) if len(g) else None)
            return out

        return work

    sketched = shared(map_rows(source, ["text"], "set binary, n_grams int, paths array<long>", sketch, ["doc_id", "key"]))
    sets = shared(
        sketched.where("set is not null").groupBy("set")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("least"), F.count("*").alias("n_copies"), F.max("n_grams").alias("n_grams"), F.first("paths").alias("paths"))
        .select("set", F.col("least.doc_id").alias("copy_id"), F.col("least.key").alias("key"), "n_copies", "n_grams", "paths")
    )
    found, classes = linked_sets(source, sets, n, similarity, trees, recall)

    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    whole = sets.select("set", "copy_id", "n_copies", "key").join(links, "set", "left").join(classes, "set", "left").withColumn("root", F.coalesce("root", "set"))
    heads = whole.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.min(F.struct(F.col("copy_id").isNull(), "copy_id", "key"))["key"].alias("keep_key"))
    known = whole.join(heads, "root").select("set", "class_id", "copy_id", "n_copies", (F.col("n_copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "keep_key")
    out = ("doc_id", "class_id", "copy_id", "n_copies", "n_links", "keep_key")
    with_words = sketched.where("set is not null").select("doc_id", "set").join(known, "set").select(*out)
    without = sketched.where("set is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("keep_key"))
    return with_words.unionByName(without)


def linked_sets(source: DataFrame, sets: DataFrame, n: int, similarity: float, trees: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Links of each set (set, links), in parts, and (set, root) of the sets that links join."""

    def regram():
        grams = Grams(n)

        def work(texts, sets):
            out = []
            for g, s in zip(grams.of(texts), sets, strict=True):
                out.append(g.tobytes() if len(g) and blake2b(g.tobytes(), digest_size=16).digest() == s else None)
            return (out,)

        return work

    edges = found = known = None
    for depth in range(LONGEST, 0, -1):
        new = shared(trie_edges(sets, depth, similarity))
        edges = new if edges is None else edges.union(new)
        clusters = shared(components(edges).select(F.col("node").alias("set"), F.col("root").alias("cluster")))
        members = clusters.join(sets.select("set", "key", "n_copies", "n_grams"), "set")
        marks = shared(clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.xxhash64("set").cast("decimal(20,0)")).alias("mark")))
        if known is not None:  # clusters that shorter prefixes leave as they were have been compared
            found = found.join(marks.join(known, ["cluster", "n", "mark"], "left_semi").select("cluster"), "cluster", "left_semi")
            members = members.join(marks.join(known, ["cluster", "n", "mark"], "left_anti").select("cluster"), "cluster", "left_semi")
        known = marks
        parts = members.groupBy("cluster").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("parts"))
        placed = members.join(parts, "cluster").withColumn("block", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")).select("key", "set", "cluster", "block", "parts", "n_copies")
        slot = F.pmod(F.col("key"), F.lit(SLOTS)).cast("int").alias("slot")
        own = source.select("key", "text", slot).join(F.broadcast(placed.select(slot).distinct()), "slot", "left_semi").drop("slot")
        # rows that repeat have one key and meet in one partition, which adaptive execution splits if it is very large
        grams = map_rows(own.join(placed, "key"), ["text", "set"], "grams binary", regram, ["cluster", "set", "block", "parts", "n_copies"]).where("grams is not null")
        full = grams.groupBy("set", "cluster", "block", "parts", "n_copies").agg(F.first("grams").alias("grams"))
        dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
            "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "set", "block", "n_copies", "grams"
        )
        ordered = dealt.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high")
        compared = ordered.mapInArrow(compare(similarity, trees), "cluster binary, set binary, root binary, links long, near long, met array<double>")
        found = shared(compared if found is None else compared.unionByName(found))
        total = found.agg(F.sum("near").alias("near"), F.sum(F.col("met")[depth - 1]).alias("met")).first()
        if (total.near or 0) >= recall * (total.met or 0):
            break
    classes = components(found.select(F.col("set").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "set")
    return found, classes

"""Regression trees on panels: forests and boosting of every cut-off in time from shared histograms.

Features are binned once. A level of a tree is chosen from one histogram, by node, feature and bin, of the rows before
the cut-off; rows lie in order of time, so that every cut-off's rows are the first so many. Targets are whole multiples
of a small unit: sums are exact, and the trees depend on no partition and no order of rows.

Panels of at most LOCAL_ROWS rows are sent to the tasks, and each task fits whole cut-offs. Larger ones stay where they
are: Spark sums the histograms of all cut-offs at once, level by level, and the driver sees histograms alone. Both ways
run the same steps and give the same trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.workers import shared, ship

#: Rows of a panel that is sent to tasks, at most: some 20 MB with five features.
LOCAL_ROWS = 500_000
#: Numbers in the histograms of one round over a larger panel, at most; more trees take more rounds.
ROUND_NUMBERS = 2_000_000
#: Targets lie within this many units around zero.
UNITS = 1 << 30
#: How often a row is drawn: bounds of a Poisson variable of mean 1.
_DRAWS = np.exp(-1.0) * np.cumsum(1 / np.cumprod(np.r_[1.0, np.arange(1, 12)]))


@dataclass(frozen=True)
class Kind:
    """boosting: each tree learns what the ones before left over; else trees of drawn rows, whose mean is taken."""

    boosting: bool
    trees: int
    depth: int
    rate: float = 0.1
    seed: int = 42

    @property
    def nodes(self) -> int:
        return (2 << self.depth) - 1


def kind_of(name: str, trees: int = 100, depth: int | None = None) -> Kind:
    boosting = {"gradient_boosting": True, "random_forest": False}[name]
    return Kind(boosting, trees, depth or (3 if boosting else 5))


@dataclass
class Trees:
    """The trees of several cut-offs; node k has the children 2k + 1 (bins up to `bin`) and 2k + 2; feature -1: a leaf."""

    kind: Kind
    cuts: np.ndarray
    unit: float
    base: np.ndarray = field(init=False)
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    gain: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        shape = (len(self.cuts), self.kind.trees, self.kind.nodes)
        self.base, self.feature, self.bin = np.zeros(len(self.cuts)), np.full(shape, -1, dtype=np.int16), np.zeros(shape, dtype=np.int16)
        self.value, self.gain = np.zeros(shape), np.zeros(shape)

    def split(self, hist: np.ndarray, trees: Sequence[int], level: int) -> bool:
        """Chooses the splits of a level; hist: cut-off, tree, node, feature, bin -> rows and sum of units. False if none gains."""
        n, s = np.moveaxis(np.cumsum(hist, axis=4).astype(np.float64), 5, 0)
        whole_n, whole_s = n[..., :1, -1:], s[..., :1, -1:]
        ln, ls, rn, rs = n[..., :-1], s[..., :-1], whole_n - n[..., :-1], whole_s - s[..., :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            before = np.where(whole_n > 0, whole_s**2 / whole_n, 0.0)
            gain = np.where((ln > 0) & (rn > 0), ls**2 / ln + rs**2 / rn - before, -1.0)
        flat = gain.reshape(*gain.shape[:3], -1)
        at = flat.argmax(axis=3)  # the first feature and the lowest bin of equal ones
        best = np.take_along_axis(flat, at[..., None], axis=3)[..., 0]
        good = best > 1e-9 * before[..., 0, 0] + 1.0
        picked = lambda x: np.take_along_axis(np.broadcast_to(x, gain.shape).reshape(flat.shape), at[..., None], axis=3)[..., 0]
        first = (1 << level) - 1
        own = np.s_[:, list(trees), first : first + (1 << level)]
        bins = gain.shape[4]
        self.feature[own], self.bin[own], self.gain[own] = np.where(good, at // bins, -1), np.where(good, at % bins, 0), np.where(good, best, 0.0)
        for side, (sn, ss) in enumerate(((ln, ls), (rn, rs))):
            to = np.s_[:, list(trees), 2 * first + 1 + side : 4 * first + 3 : 2]
            with np.errstate(divide="ignore", invalid="ignore"):
                self.value[to] = np.where(good, picked(ss) / picked(sn), 0.0) * self.unit
        return bool(good.any())

    def leaves(self, c: int, t: int, bins: np.ndarray) -> np.ndarray:
        """Where each row of bins ends in a tree."""
        node = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.kind.depth):
            f = self.feature[c, t, node]
            down = 2 * node + 1 + (bins[rows, f] > self.bin[c, t, node])
            node = np.where(f < 0, node, down)
        return node

    def predict(self, c: int, bins: np.ndarray, first: int = 0, total: np.ndarray | None = None, trees: int | None = None) -> np.ndarray:
        """base and the first trees' values; total: what the trees before `first` came to."""
        total = np.full(len(bins), self.base[c] if self.kind.boosting else 0.0) if total is None else total
        for t in range(first, self.kind.trees if trees is None else trees):
            total = total + (self.kind.rate if self.kind.boosting else 1.0) * self.value[c, t, self.leaves(c, t, bins)]
        return total if self.kind.boosting or trees is not None else self.base[c] + total / self.kind.trees

    def importance(self, c: int, features: int) -> np.ndarray:
        """Each feature's share of the gains, tree by tree, and their mean."""
        shares = np.zeros(features)
        for t in range(self.kind.trees):
            own = self.feature[c, t] >= 0
            if own.any():
                gains = np.bincount(self.feature[c, t][own], weights=self.gain[c, t][own], minlength=features)
                shares += gains / gains.sum()
        return shares / shares.sum() if shares.any() else shares


class Rows:
    """Rows in order of time, with what the finished trees make of them."""

    def __init__(self, bins: np.ndarray, at: np.ndarray, y: np.ndarray, key: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        self.bins, self.at, self.y, self.key = bins[order], at[order], y[order], key[order].astype(np.uint64)
        self.so_far: dict[int, tuple[int, np.ndarray]] = {}

    def totals(self, trees: Trees) -> np.ndarray:
        """Rows and sum of units before each cut-off."""
        units = np.r_[0, np.cumsum(np.rint(self.y / trees.unit).astype(np.int64))]
        n = np.searchsorted(self.at, trees.cuts)
        return np.stack([n, units[n]], axis=1)

    def _left_over(self, trees: Trees, c: int, n: int, t: int) -> np.ndarray:
        if not trees.kind.boosting:
            return np.rint((self.y[:n] - trees.base[c]) / trees.unit)
        done, total = self.so_far.get(c, (0, None))
        if done != t or total is None:
            total = trees.predict(c, self.bins[:n], done, total, t)
            self.so_far[c] = t, total
        return np.rint((self.y[:n] - total) / trees.unit)

    def _drawn(self, kind: Kind, n: int, t: int) -> np.ndarray:
        z = self.key[:n] ^ np.uint64((kind.seed * 1_000_003 + t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values: a 64-bit mixer
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        return np.searchsorted(_DRAWS, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, side="right")

    def histograms(self, trees: Trees, group: Sequence[int], level: int, width: int) -> np.ndarray:
        features, nodes, first = self.bins.shape[1], 1 << level, (1 << level) - 1
        out = np.zeros((len(trees.cuts), len(group), nodes, features, width, 2), dtype=np.int64)
        for c, n in enumerate(np.searchsorted(self.at, trees.cuts).tolist()):
            bins = self.bins[:n]
            for g, t in enumerate(group):
                target = self._left_over(trees, c, n, t)
                weight = np.ones(n) if trees.kind.boosting else self._drawn(trees.kind, n, t).astype(np.float64)
                node = trees.leaves(c, t, bins) - first if level else np.zeros(n, dtype=np.int64)
                live = np.flatnonzero((node >= 0) & (weight > 0))
                at = ((node[live, None] * features + np.arange(features)) * width + bins[live]).ravel()
                for k, w in enumerate((weight, weight * target)):
                    out[c, g, ..., k] = np.bincount(at, weights=np.repeat(w[live], features), minlength=nodes * features * width).reshape(nodes, features, width)
        return out


Histograms = Callable[[Trees, Sequence[int], int], np.ndarray]


def grow(trees: Trees, totals: np.ndarray, histograms: Histograms, wave: int) -> Trees:
    """Fits all trees: boosting tree by tree, a forest `wave` trees at a time, each level from one call of histograms."""
    with np.errstate(divide="ignore", invalid="ignore"):
        trees.base = np.where(totals[:, 0] > 0, totals[:, 1] / totals[:, 0], 0.0) * trees.unit
    step = 1 if trees.kind.boosting else max(1, wave)
    for low in range(0, trees.kind.trees, step):
        group = range(low, min(trees.kind.trees, low + step))
        for level in range(trees.kind.depth):
            if not trees.split(histograms(trees, group, level), group, level):
                break
    return trees


@dataclass
class Fitted:
    """A binned panel (its columns, __bins and __at) and the trees of its cut-offs by kind."""

    rows: DataFrame
    features: Sequence[str]
    trees: dict[str, Trees]

    def predict(self, *, at_cuts: bool, out: str = "prediction") -> DataFrame:
        """The panel's columns with `kind` and `out`, once for each kind.

        at_cuts: rows at a cut-off are predicted from the rows before it, others left out; else all by the last cut-off.
        """
        sent = self.rows.sparkSession.sparkContext.broadcast(self.trees)
        kept = [f for f in self.rows.schema.fields if not f.name.startswith("__")]
        names = [*(f.name for f in kept), "kind", out]
        features = len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins, at, _, _ = _arrays(b, len(kept), features)
                for name, trees in sent.value.items():
                    made, known = np.zeros(len(at)), np.full(len(at), not at_cuts)
                    for c, cut in enumerate(trees.cuts.tolist()) if at_cuts else [(len(trees.cuts) - 1, None)]:
                        own = np.flatnonzero(at == cut) if at_cuts else np.arange(len(at))
                        if len(own):
                            made[own], known[own] = trees.predict(c, bins[own]), True
                    keep = pa.array(np.flatnonzero(known))
                    columns = [b.column(i).take(keep) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * len(keep)), pa.array(made[known])], names=names)

        return self.rows.select(*(f"`{f.name}`" for f in kept), *_FED).mapInArrow(run, T.StructType([*kept, T.StructField("kind", T.StringType()), T.StructField(out, T.DoubleType())]))

    def importance(self) -> DataFrame:
        """(kind, feature, importance, place) of the last cut-off's trees; the sum of a kind is 1."""
        found = []
        for name, trees in self.trees.items():
            shares = trees.importance(len(trees.cuts) - 1, len(self.features)) if len(trees.cuts) else np.zeros(len(self.features))
            ranked = sorted(zip(self.features, shares.tolist(), strict=True), key=lambda r: (-r[1], r[0]))
            found += [(name, f, v, k + 1) for k, (f, v) in enumerate(ranked)]
        return self.rows.sparkSession.createDataFrame(found, "kind string, feature string, importance double, place int")


_FED = ("__bins", "__at", "__y", "__key")


def _arrays(b: pa.RecordBatch, first: int, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bins, at, y and key of a batch, of which they are the columns from `first` on."""
    bins = np.frombuffer(b"".join(b.column(first).to_pylist()), dtype=np.uint8).reshape(-1, features)
    return bins, *(b.column(first + i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))


def binned(rows: DataFrame, features: Sequence[str], target: str, at: str, width: int) -> tuple[DataFrame, int, float]:
    """rows with a target and a time, written once, with __bins, __at, __y and __key; their number; the unit of targets.

    A feature's bins end at its quantiles over all rows; a null counts as 0.
    """
    own = rows.where(F.col(target).isNotNull() & F.col(at).isNotNull())
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    own = own.withColumn("__x", F.array(*x)).withColumn("__y", F.col(target).cast("double")).withColumn("__at", F.col(at).cast("long"))
    own = shared(own.withColumn("__key", F.xxhash64(*(c for c, k in own.dtypes if not k.startswith("map")))))
    shares = [k / width for k in range(1, width)]
    stats = own.agg(F.count("*").alias("n"), F.max(F.abs("__y")).alias("m"), *(F.percentile_approx(F.col("__x")[i], shares, F.lit(10_000)).alias(f"q{i}") for i in range(len(features)))).first()
    ends = [np.unique(stats[f"q{i}"] or [0.0]) for i in range(len(features))]
    kept = [f for f in own.schema.fields if f.name != "__x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.asarray(b.column(0).flatten()).reshape(-1, len(ends))
            bins = np.stack([np.searchsorted(e, values[:, i]) for i, e in enumerate(ends)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([r.tobytes() for r in bins], pa.binary())], names=[*(f.name for f in kept), "__bins"])

    made = own.select("__x", *(f"`{f.name}`" for f in kept)).mapInArrow(run, T.StructType([*kept, T.StructField("__bins", T.BinaryType())]))
    return shared(made), stats.n, 2 * (stats.m or 1.0) / UNITS


def fit(rows: DataFrame, features: Sequence[str], target: str, kinds: dict[str, Kind], *, at: str, cuts: Sequence[int] | None = None, least: int | None = None, width: int = 64) -> Fitted:
    """Trees of each kind for each cut-off, from the rows whose `at` lies before it.

    cuts: the cut-offs, by default every `at` of the panel but the first `least`, or without `least` one after all rows.
    width: bins of a feature, 256 at most.
    """
    spark = rows.sparkSession
    ship(spark)
    table, n, unit = binned(rows, features, target, at, width)
    if cuts is None:
        days = table.select("__at").distinct()  # a row for each date of the calendar
        cuts = sorted(r[0] for r in days.collect())[least:] if least is not None else [r[0] + 1 for r in table.agg(F.max("__at")).collect() if r[0] is not None]
    start = {name: Trees(kind, np.array(cuts, dtype=np.int64), unit) for name, kind in kinds.items()}
    if not len(cuts):
        return Fitted(table, features, start)
    made = _in_tasks(table, len(features), start, width) if n <= LOCAL_ROWS else _by_rounds(table, len(features), start, width)
    return Fitted(table, features, made)


def _in_tasks(table: DataFrame, features: int, start: dict[str, Trees], width: int) -> dict[str, Trees]:
    """Each task takes kinds and cut-offs; the panel, which is small, is sent to all."""
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast(_arrays(table.select(*_FED).toArrow().combine_chunks().to_batches()[0], 0, features))
    jobs = [(name, c) for name, trees in start.items() for c in range(len(trees.cuts))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(*sent.value)
        for b in batches:
            raw = []
            for name, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                whole = start[name]
                trees, rows.so_far = Trees(whole.kind, whole.cuts[c : c + 1], whole.unit), {}
                raw.append(pickle.dumps(grow(trees, rows.totals(trees), lambda *a: rows.histograms(*a, width), 10)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["kind", "c", "trees"])

    dealt = spark.createDataFrame(jobs, "kind string, c int").repartition(min(len(jobs), 2 * spark.sparkContext.defaultParallelism), "kind", "c")
    for r in dealt.mapInArrow(run, "kind string, c int, trees binary").toLocalIterator():
        part, whole = pickle.loads(bytes(r.trees)), start[r.kind]  # noqa: S301  what run() has written
        for name in ("base", "feature", "bin", "value", "gain"):
            getattr(whole, name)[r.c] = getattr(part, name)[0]
    return start


def _by_rounds(table: DataFrame, features: int, start: dict[str, Trees], width: int) -> dict[str, Trees]:
    """All cut-offs together: a round is one pass over the panel, whose histograms Spark sums."""
    sc, fed = table.sparkSession.sparkContext, table.select(*_FED)

    def summed(trees: Trees, of: Callable[[Rows, Trees], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        sent = sc.broadcast(trees)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, dtype=np.int64)
            for b in batches:
                total += of(Rows(*_arrays(b, 0, features)), sent.value)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], names=["at", "v"])

        out = np.zeros(shape, dtype=np.int64)
        for r in fed.mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).toLocalIterator():
            out.ravel()[r.at] = r.v
        sent.unpersist()
        return out

    for trees in start.values():
        cuts = len(trees.cuts)
        wave = ROUND_NUMBERS // (cuts * (1 << trees.kind.depth - 1) * features * width * 2)

        def histograms(trees: Trees, group: Sequence[int], level: int, cuts: int = cuts) -> np.ndarray:
            return summed(trees, lambda rows, t: rows.histograms(t, group, level, width), (cuts, len(group), 1 << level, features, width, 2))

        grow(trees, summed(trees, lambda rows, t: rows.totals(t), (cuts, 2)), histograms, wave)
    return start


def tree_walk_forward(rows: DataFrame, features: Sequence[str], target: str, *, at: str = "qidx", kinds: Sequence[str] = ("gradient_boosting",), trees: int = 100, least: int = 3, keys: Sequence[str] = ("entity",), width: int = 64) -> DataFrame:
    """keys, at, kind, actual, prediction: every row past the first `least` dates is predicted by trees of earlier rows."""
    done = fit(rows.select(*keys, at, target, *features), features, target, {k: kind_of(k, trees) for k in kinds}, at=at, least=least, width=width)
    return done.predict(at_cuts=True).select(*keys, at, "kind", F.col(target).cast("double").alias("actual"), "prediction")

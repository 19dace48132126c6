"""Trees from shared histograms against a fit that tries every split of the raw rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import trees as tr

FEATURES = ["x", "noise", "late"]


def panel(n=200, seed=1):
    rng = np.random.default_rng(seed)
    x, noise, late = rng.integers(0, 12, n) / 4.0, rng.integers(-5, 6, n) * 1.0, rng.integers(0, 3, n) * 10.0
    y = np.where(x > 1.3, 5.0, -1.0) + 0.2 * late + np.round(rng.normal(size=n), 3)
    return [(f"E{k % 20}", 8000 + k // 20, float(x[k]), None if k % 17 == 0 else float(noise[k]), float(late[k]), float(y[k])) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity string, qidx int, x double, noise double, late double, y double")


def grown(x, y, w, depth):
    """(where rows fall, by what value) of a tree by trying every split; x: rows by features."""
    out = np.zeros(len(y))

    def node(rows, left):
        live = rows[w[rows] > 0]
        if not len(live):
            return
        n, s = w[live].sum(), (w * y)[live].sum()
        out[rows] = s / n
        if not left:
            return
        best = (1e-6, None, None)
        for f in range(x.shape[1]):
            for v in np.unique(x[live, f])[:-1]:
                a, b = live[x[live, f] <= v], live[x[live, f] > v]
                gain = (w * y)[a].sum() ** 2 / w[a].sum() + (w * y)[b].sum() ** 2 / w[b].sum() - s * s / n
                if gain > best[0] + 1e-9:
                    best = (gain, f, v)
        if best[1] is not None:
            # rows that were not drawn follow the split of the bins
            node(rows[x[rows, best[1]] <= best[2]], left - 1)
            node(rows[x[rows, best[1]] > best[2]], left - 1)

    node(np.arange(len(y)), depth)
    return out


def brute_boosting(x, y, now, trees, depth=3, rate=0.1):
    """Predictions of `now` rows: they follow the splits with weight 0."""
    every, weight = np.vstack([x, now]), np.r_[np.ones(len(x)), np.zeros(len(now))]
    target, total = np.r_[y, np.zeros(len(now))], np.full(len(every), y.mean())
    for _ in range(trees):
        total = total + rate * grown(every, target - total, weight, depth)
    return total[len(x) :]


@pytest.mark.parametrize("local_rows", [500_000, 0])
def test_walk_forward_against_every_split(spark, monkeypatch, local_rows):
    monkeypatch.setattr(tr, "LOCAL_ROWS", local_rows)
    rows = panel()
    got = tr.tree_walk_forward(frame(spark, rows).repartition(3), FEATURES, "y", trees=3, least=4).collect()
    x = np.array([[r[2], r[3] or 0.0, r[4]] for r in rows])
    q, y = np.array([r[1] for r in rows]), np.array([r[5] for r in rows])
    assert len(got) == 120 and {r.kind for r in got} == {"gradient_boosting"}
    found = {(r.entity, r.qidx): (r.actual, r.prediction) for r in got}
    for cut in sorted(set(q))[4:]:
        want = brute_boosting(x[q < cut], y[q < cut], x[q == cut], 3)
        for k, p in zip(np.flatnonzero(q == cut), want, strict=True):
            actual, prediction = found[rows[k][0], cut]
            assert actual == rows[k][5] and abs(prediction - p) < 1e-6


def test_forest_against_every_split_of_drawn_rows(spark):
    rows = panel(120, 3)
    done = tr.fit(frame(spark, rows), FEATURES, "y", {"f": tr.Kind(False, 4, 3)}, at="qidx")
    made = {(r.entity, r.qidx): r.prediction for r in done.predict(at_cuts=False).collect()}
    held = done.rows.select("entity", "qidx", "x", F.coalesce("noise", F.lit(0.0)), "late", "y", "__key").collect()
    x, y, key = np.array([r[2:5] for r in held]), np.array([r[5] for r in held]), np.array([r[6] for r in held])
    draw = tr.Rows(np.zeros((len(y), 1), dtype=np.uint8), np.zeros(len(y)), y, key)
    weights = [draw._drawn(tr.Kind(False, 4, 3), len(y), t) for t in range(4)]
    assert abs(np.mean(weights) - 1) < 0.15 and not np.array_equal(weights[0], weights[1])
    want = y.mean() + np.mean([grown(x, y - y.mean(), w.astype(float), 3) for w in weights], axis=0)
    assert all(abs(made[r[0], r[1]] - p) < 1e-6 for r, p in zip(held, want, strict=True))


def test_both_ways_and_any_partition_give_the_same_trees(spark, monkeypatch):
    rows, kinds = panel(160, 4), {"gradient_boosting": tr.Kind(True, 4, 3), "random_forest": tr.Kind(False, 5, 4)}
    made = []
    for parts, most in ((1, 500_000), (7, 500_000), (1, 0), (5, 0)):
        monkeypatch.setattr(tr, "LOCAL_ROWS", most)
        done = tr.fit(frame(spark, rows).repartition(parts), FEATURES, "y", kinds, at="qidx", least=5)
        made.append([(t.base.tolist(), t.feature.tolist(), t.bin.tolist(), t.value.tolist()) for t in done.trees.values()])
    assert made[0] == made[1] == made[2] == made[3]


def test_the_planted_feature_is_the_most_important(spark):
    done = tr.fit(frame(spark, panel(400, 5)), FEATURES, "y", {k: tr.kind_of(k, 10) for k in ("gradient_boosting", "random_forest")}, at="qidx")
    table = done.importance().collect()
    for kind in ("gradient_boosting", "random_forest"):
        own = [r for r in table if r.kind == kind]
        assert [r.place for r in own] == [1, 2, 3] and own[0].feature == "x" and own[1].feature == "late"
        assert abs(sum(r.importance for r in own) - 1) < 1e-9


def test_importance_is_the_share_of_the_gains(spark):
    rows = [(f"E{k}", 1, float(k % 4), 0.0, float(k // 4 % 2), (8.0 if k % 4 > 1 else 0.0) + (2.0 if k // 4 % 2 else 0.0)) for k in range(80)]
    done = tr.fit(frame(spark, rows), FEATURES, "y", {"one": tr.Kind(True, 1, 2, rate=1.0)}, at="qidx")
    shares = {r.feature: r.importance for r in done.importance().collect()}
    assert abs(shares["x"] - 16 / 17) < 1e-9 and abs(shares["late"] - 1 / 17) < 1e-9 and shares["noise"] == 0
    assert {round(r.prediction, 6) for r in done.predict(at_cuts=False).collect()} == {0.0, 2.0, 8.0, 10.0}


def test_short_and_empty_panels(spark):
    rows = frame(spark, panel(40))
    assert tr.tree_walk_forward(rows, FEATURES, "y", trees=2, least=3).count() == 0
    assert tr.tree_walk_forward(rows.where("y > 1000"), FEATURES, "y", trees=2).count() == 0
    assert tr.fit(rows.where("y > 1000"), FEATURES, "y", {"f": tr.kind_of("random_forest", 2)}, at="qidx").predict(at_cuts=False).count() == 0
    flat = tr.fit(rows.withColumn("y", F.lit(3.5)), FEATURES, "y", {"f": tr.kind_of("random_forest", 2)}, at="qidx").predict(at_cuts=False)
    assert {r.prediction for r in flat.collect()} == {3.5}

"""Labels by one automaton against trying every entry."""

from __future__ import annotations

import random

import pytest

from ledgerline.operators import segments as se


def tried(entries, label):
    clean = None if label is None else label.strip(" ").lower()
    hits = [(k != clean, i) for i, (k, _) in enumerate(entries) if clean is not None and (k == clean or k in clean or (clean and clean in k))]
    return min(hits)[1] if hits else None


@pytest.mark.parametrize("seed", range(5))
def test_first_entry_of_each_label(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abc &") for _ in range(rng.randint(1, n)))
    entries = [(word(7), f"c{i % 5}") for i in range(40)]
    labels = [word(12).strip(" ").lower() for _ in range(400)] + [None, "", entries[3][0].strip(" "), "\0", "a\0b"]
    assert se.Dictionary(entries).first(labels) == [tried(entries, x) for x in labels]


def test_rows_and_notes(spark):
    labels = se.label_table(spark)
    rows = spark.createDataFrame([(1, " Gaming "), (2, "gpu business unit"), (3, "pro"), (4, "Widgets"), (5, None), (6, ""), (1, " Gaming ")], "id int, original_label string")
    got = sorted((r.id, r.normalized_category, r.mapping_notes) for r in se.label_normalise(rows, labels).collect())
    assert got == [(1, "gaming", ""), (1, "gaming", ""), (2, "gpu", "partial match: gpu"), (3, "tegra", "partial match: tegra processor"), (4, "other", "unmapped label"), (5, "other", "unmapped label"), (6, "other", "unmapped label")]
    empty = se.label_normalise(rows, labels.limit(0))
    assert {r.normalized_category for r in empty.collect()} == {"other"}

"""The training-data operators against brute force, libraries and held-out labels, and on awkward rows."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import bpe, cover_tree, decontaminate, html_text, ngram_join, pll, quality, secrets, token_counts, toxicity
from ledgerline.llm.labelled import remainder

P = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in rng.integers(0, 400, n))


#: Rows that every text operator must take: null, empty, no words, repeated rows, long, not ASCII; a column that clashes.
AWKWARD = [(None, "no id"), (1, None), (2, ""), (3, " \n\t!! "), (4, "repeat me"), (4, "repeat me"), (5, "Ünï 👩‍👩‍👧 ½ 一二 Σ ΟΔΟΣ don't <|endoftext|>x"), (6, "ab" * 3000 + " " + "long words " * 20_000)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string").withColumn("N_Words", F.lit("clash")).withColumn("ids", F.lit(1))


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def brute_hits(text, items, size=13):
    words, hit, names = WORDS.findall(lower(text)), set(), set()
    for item, t in items:
        own = WORDS.findall(lower(t))
        n = min(size, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                names.add(item)
    return len(words), len(hit), sorted(n for n in names if n is not None)


@pytest.mark.parametrize("room", [1_000_000, 30])
def test_decontamination_against_brute_force(spark, room):
    items = [("a", passage(1, 40)), ("b", "w1 w2 w3"), ("c", "w7"), ("d", passage(1, 40)[60:] + " tail"), ("e", ""), (None, passage(3, 20))]
    texts = [passage(9, 50), f"X {passage(1, 40).upper()} w7, w1-w2 W3", passage(1, 40)[30:130], "w1 w2 w1 w2 w3 w3", passage(3, 20) + " " + passage(1, 14), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_overlaps(docs, bench, words_per_automaton=room).collect()}
    for k, t in enumerate(texts):
        n, h, names = brute_hits(t, items)
        assert got[k] == (n, h, names), k


def test_decontamination_awkward(spark, awkward):
    out = decontaminate.find_overlaps(awkward, spark.createDataFrame([], "item_id int, text string"))
    assert out.count() == len(AWKWARD) and out.agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_overlaps(empty(spark), spark.createDataFrame([(1, "a b")], "item_id int, text string")).count() == 0
    cut = decontaminate.cut_hits(decontaminate.find_overlaps(spark.createDataFrame([(1, "Say: one, TWO three! end")], "doc_id int, text string"), spark.createDataFrame([(1, "two three")], "item_id int, text string")))
    assert cut.first().text == "Say: one, ! end"


def test_byte_bpe_against_the_library(spark, awkward):
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.decode(bpe.encode(awkward, path, P.PATTERN), path)
    for r in coded.collect():
        assert r.ids == own.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty(spark), path, P.PATTERN).count() == 0


@pytest.mark.parametrize("room", [100_000, 5, 0])
def test_byte_bpe_replays_the_corpus_once(spark, monkeypatch, room):
    """The table holds the most frequent pre-tokens of all rows, at most as many as there is room for; ids don't depend on it."""
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [f"{'common ' * 40}{'often ' * (k % 7)}shared{k % 3} Ünï{k} {'z' * 70} once{k * 7919}\xff" for k in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    monkeypatch.setattr(bpe, "TABLE_WORDS", room)
    monkeypatch.setattr(bpe, "COUNTED_WORDS", 10)
    table = bpe.corpus_table(docs, path, P.PATTERN)
    words = [w.decode() for w in table.words.split(b"\xff")[:-1]]
    counts = Counter(w for t in texts for w in bpe.splitter(P.PATTERN)(t or ""))
    assert {r.word: r.n for r in bpe.counted(docs, P.PATTERN).collect()} == counts
    able = {w for w, n in counts.items() if n > 1 and len(w.encode()) <= bpe.TABLE_BYTES}
    assert len(words) == len(set(words)) == len(table.ends) - 1 <= room and set(words) <= able
    assert set(words) == able if room == 100_000 else (" common" in words) == (room > 0)
    for w, a, b in zip(words, table.ends[:-1], table.ends[1:], strict=True):
        assert table.ids[a:b].tolist() == lib.encode_ordinary(w)
    encoder = bpe.Encoder(path, P.PATTERN, table)
    next(encoder.encode([["".join(w for w in words if w == " common")]]))
    assert len(encoder.ends) == len(table.ends)  # nothing is replayed again
    for r in bpe.encode(docs, path, P.PATTERN, decoded="decoded").collect():
        assert r.ids == lib.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_replay_takes_a_neighbour_of_lower_rank_first():
    """Token bytes that arise in two ways make pairs of lower rank than the merge that made them possible."""
    tiktoken = pytest.importorskip("tiktoken")
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"ab", b"aa", b"aab", b"ba", b"bab", b"aaaa"]
    ranks = {t: i for i, t in enumerate(tokens)}
    merges = {ranks[t[:i]] * bpe.PAIR + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    own = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 14))) for _ in range(400)]
    out = bpe.replay(bpe.symbols_of([w.encode() for w in words], range(256)), bpe.Merges(merges, range(len(tokens))))
    ends = np.flatnonzero(out == -1)
    for w, a, b in zip(words, np.r_[0, ends[:-1] + 1], ends, strict=True):
        assert out[a:b].tolist() == own.encode_ordinary(w)


def test_token_counts_against_the_library(spark, awkward):
    tokenizers = pytest.importorskip("tokenizers")
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in token_counts.count_tokens(awkward, P.path("word_bpe_49k.json")).collect():
        assert (r.n_tokens, r.n_bytes) == (len(lib.encode(r.text or "", add_special_tokens=False).ids), len((r.text or "").encode()))


def random_texts(n, seed):
    """Texts of all kinds of characters, new and old, with marks, special strings and white space."""
    rng = np.random.default_rng(seed)
    blocks = [(32, 127), (0xA0, 0x590), (0x300, 0x370), (0x800, 0xE00), (0x1AB0, 0x1B00), (0x1C80, 0x1C90), (0x1DF0, 0x2070), (0xA7C0, 0xA800), (0xAC00, 0xAD00), (0x10D00, 0x10F90), (0x11380, 0x113E0), (0x11900, 0x11950), (0x13C00, 0x14400), (0x16EA0, 0x16ED4), (0x1E000, 0x1E600), (0x1F600, 0x1F650)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 6)):
            a, b = blocks[rng.integers(len(blocks))] if rng.random() < 0.9 else (0, 0x110000)
            parts += [chr(c) for c in rng.integers(a, b, rng.integers(1, 6)) if not 0xD800 <= c < 0xE000]
            parts.append(rng.choice(["", " ", "\t\n", "the", "İstanbul Σ", "<|endoftext|>", "1234", "'s"]))
        out.append("".join(parts))
    return out


def every_character():
    return ["".join(chr(c) + " x" for c in range(low, low + 64) if not 0xD800 <= c < 0xE000) for low in range(0, 0x110000, 64)]


def test_token_counts_on_every_character():
    tokenizers = pytest.importorskip("tokenizers")
    lib, own = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json")), token_counts.Counted(P.path("word_bpe_49k.json"))
    texts = every_character() + random_texts(10_000, 1)
    want = [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, own.counts(texts).tolist(), want, strict=True) if a != b] == []


def test_byte_bpe_on_every_character():
    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = every_character() + random_texts(10_000, 2)
    ((ids, ends),) = bpe.Encoder(path, P.PATTERN).encode([texts])
    want = lib.encode_ordinary_batch(texts)
    assert [t for t, a, b, w in zip(texts, ends[:-1], ends[1:], want, strict=True) if ids[a:b].tolist() != w] == []


@pytest.mark.parametrize("text", ["a" * 1_000_000, "ab" * 400_000, "=" * 1_000_000, "aab" * 3000])
def test_long_runs_take_seconds(text):
    import time

    tiktoken = pytest.importorskip("tiktoken")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoder, began = bpe.Encoder(path, P.PATTERN), time.process_time()
    ((ids, _),) = encoder.encode([[text]])
    assert time.process_time() - began < 20 and bpe.Encoder(path, P.PATTERN).split(text) == [text]
    if len(text) < 10_000:  # the library itself is quadratic
        lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
        assert ids.tolist() == lib.encode_ordinary(text)
    assert token_counts.Counted(P.path("word_bpe_49k.json")).counts([text])[0] > 0


def brute_classes(texts):
    sets = []
    for t in texts:
        w = WORDS.findall(lower(t))
        sets.append({tuple(w[k : k + min(5, len(w))]) for k in range(max(len(w) - 4, 1))} if w else set())
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], links


def test_ngram_join_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)  # a group of copies then fills several blocks
    monkeypatch.setattr(ngram_join, "NODE_ROWS", 8)
    base = passage(5, 120).split()
    texts = [None, "", "short one", "Short, one!", *(passage(k, 60) for k in range(10, 30))]
    for k in range(40):
        w = list(base)
        w[3 * k % 120] = f"x{k}"
        texts.append(" ".join(w))
    texts += [passage(12, 60), passage(12, 60).upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.near_duplicates(docs).collect()}
    roots, links = brute_classes(texts)
    assert [(got[k].class_id, got[k].n_links) for k in range(len(texts))] == list(zip(roots, links, strict=True))
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("few", [0, 40, 100_000])
def test_components(spark, few):
    from ledgerline.llm.components import components

    rng = np.random.default_rng(7)
    edges = [(hashlib.md5(b"%d" % a).digest(), hashlib.md5(b"%d" % b).digest()) for a, b in [*rng.integers(0, 300, (180, 2)).tolist(), *((k, k + 1) for k in range(400, 460)), *((500, k) for k in range(501, 600))]]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    df = spark.createDataFrame([*edges, *edges[:5], (edges[0][0], edges[0][0]), (None, edges[0][0])], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in components(df, few=few).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_ngram_join_awkward(spark, awkward):
    got = ngram_join.near_duplicates(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert sorted(r.n_links for r in got if r.doc_id == 4) == [1, 1]
    assert [r.class_id for r in got if r.doc_id in (1, 2, 3)] == [r.doc_id for r in got if r.doc_id in (1, 2, 3)]


def test_ngram_join_clash_and_hot_rows(spark):
    rows = [(7, "the same five words and more", 0, "x")] * 400 + [(8, "the same five words and more", 1, "y"), (None, "the same five words and more", 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int, `set` string")
    got = ngram_join.near_duplicates(docs).collect()
    assert {(r.class_id, r.n_copies, r.n_links) for r in got} == {(7, 402, 401)} and len(got) == 402


def test_prefixes_are_shortened_until_the_recall_is_reached(spark, monkeypatch):
    """Pairs near the threshold are missed by whole paths; the measure asks for shorter prefixes, and not for more than are needed."""
    depths, edges = [], ngram_join.trie_edges
    monkeypatch.setattr(ngram_join, "trie_edges", lambda sets, depth, s: depths.append(depth) or edges(sets, depth, s))
    far = [passage(k, 104) for k in range(200)]
    near = [" ".join([*t.split()[:94], *(f"x{k}" for k in range(10))]) for t in far]  # 90 of 110 n-grams in common
    docs = spark.createDataFrame(list(enumerate(far + near)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs).collect()}
    assert sum(got.values()) >= 0.99 * 400 and 5 < depths[-1] < 8
    depths.clear()
    ngram_join.near_duplicates(spark.createDataFrame([(k, t) for k, t in enumerate(far + far)], "doc_id long, text string")).count()
    assert depths == [8]


def test_ngram_join_recall_on_given_documents(spark):
    """All pairs of the given documents, by an inverted index of n-grams."""
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path) if os.path.exists(path) else spark.createDataFrame([(k, passage(k % 60, 60)) for k in range(90)], "doc_id long, text string")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = {i: {tuple(w[k : k + min(5, len(w))]) for k in range(max(len(w) - 4, 1))} if (w := WORDS.findall(lower(t))) else set() for i, t in texts}
    index = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    pairs = {(a, b) for own in index.values() if len(own) > 1 for a in own for b in own if a < b}
    links = dict.fromkeys(sets, 0)
    for a, b in pairs:
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs).collect()}
    assert all(got[i] <= links[i] for i in links) and sum(got.values()) >= 0.995 * sum(links.values()) > 0


@pytest.mark.parametrize("shape", ["even", "clusters", "one"])
def test_exact_top_k_against_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(cover_tree, "CHUNK", 64)
    monkeypatch.setattr(cover_tree, "BLOCK", 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)).round(3)
    if shape == "clusters":
        x = (rng.normal(size=(8, 6))[rng.integers(0, 8, 300)] * 4 + x / 20).round(3)
    elif shape == "one":
        x[:] = x[0]
    x[50:90] = x[7]  # ties
    rows = [(int(i), v.tolist(), 1) for i, v in enumerate(x)] + [(0, x[0].tolist(), 1), (1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * 6, 1), (1003, [1.0], 1), (None, [1.0] * 6, 1), (1004, [], 1)]
    got: dict = {}
    for r in cover_tree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v, own = np.floor(1024 * x).astype(int), np.r_[np.arange(300), 0]  # the repeated row is a candidate and a query
    v = v[own]
    for q in range(0, 300, 10):
        s = v @ v[q]
        best = [j for j in np.lexsort((own, -s)) if own[j] != q][:10]
        want = [(k + 1, int(own[j]), int(s[j])) for k, j in enumerate(best)]
        assert sorted(got[q]) == sorted(want * (1 + (q == 0)))
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert cover_tree.top_k(none, F.col("vec_id") % 10 == 0).count() == 0
    assert cover_tree.top_k(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).count() == 0


def test_exact_top_k_fails_on_overflow():
    big = np.array([[2**62, 2**62]])
    with pytest.raises(OverflowError):
        cover_tree.products(big, big, big.astype(float), big.astype(float))


def test_cover_tree_covers_at_half_the_radius():
    x = (np.random.default_rng(0).normal(size=(5, 3))[np.random.default_rng(1).integers(0, 5, 2000)] * 9 + np.random.default_rng(2).normal(size=(2000, 3))).round(2)
    t = cover_tree.CoverTree(x)
    for n, below in enumerate(t.children):
        away = np.linalg.norm(x[t.order[t.start[n] : t.end[n]]] - x[t.centre[n]], axis=1)
        assert away.max() <= t.radius[n] + 1e-9 and all(t.radius[c] <= t.radius[n] / 2 + 1e-9 for c in below)


def labelled(spark, make, n=600):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for k in range(n):
        y = int(rng.random() < 0.4)
        docs.append((k, make(rng, y)))
        labels.append((k, y))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int"), dict(labels)


def test_toxicity_held_out(spark, awkward):
    bad = ["vile", "scum", "trash"]
    make = lambda rng, y: " ".join([*(f"w{k}" for k in rng.integers(0, 300, 30)), *(rng.choice(bad, 1) if y else []), "end"])
    docs, labels, y = labelled(spark, make)
    part = remainder("doc_id", 5)
    model = toxicity.train(docs, labels, part != 0, label="y")
    got = [(r.doc_id, r.score) for r in toxicity.score(docs.where(part == 0), model).collect()]
    assert np.mean([(s >= 0.5) == y[d] for d, s in got]) > 0.95 and len(model[0]) < 5000
    assert all(0 <= r.score <= 1 for r in toxicity.score(awkward, model).collect())


def test_quality_held_out(spark, awkward):
    make = lambda rng, y: " ".join(f"w{k}" if y else f"W{k}!!" for k in rng.integers(0, 300, 40))
    docs, labels, y = labelled(spark, make)
    part = remainder("doc_id", 4)
    model = quality.train(docs, labels, part != 2, label="y")
    got = [(r.doc_id, r.score) for r in quality.score(docs.where(part == 2), model).collect()]
    assert np.mean([(s >= 0.5) == y[d] for d, s in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.score(awkward, model).collect())
    none = quality.train(empty(spark), labels.limit(0), part != 2, label="y")
    assert quality.score(awkward, none).count() == len(AWKWARD)


def test_pseudo_likelihood_prefers_order(spark, awkward):
    rng = np.random.default_rng(0)
    line = "the cat sat on the mat and the dog ran to the red house by a lake".split()
    texts = [" ".join(line * 8) for _ in range(60)]
    shuffled = " ".join(rng.permutation(line * 8))
    docs = spark.createDataFrame([*enumerate(texts), (100, shuffled), (101, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pll.score(docs).collect()}
    assert got[0].mean_log_likelihood > got[100].mean_log_likelihood
    assert (got[101].n_words, got[101].log_likelihood, got[101].mean_log_likelihood) == (0, 0.0, None)
    assert pll.score(awkward).count() == len(AWKWARD)
    assert pll.score(empty(spark)).count() == 0
    same = [r.log_likelihood for r in pll.score(awkward, keep=["doc_id"]).where("doc_id = 4").collect()]
    assert len(same) == 2 and same[0] == pytest.approx(same[1], rel=1e-6)


def test_pseudo_likelihood_is_a_distribution(spark):
    docs = spark.createDataFrame([(k, passage(k, 50)) for k in range(20)], "doc_id long, text string")
    v = pll.vocabulary(docs)
    rng = np.random.default_rng(1)
    p = [x + rng.normal(0, 0.3, x.shape) * (x > pll.NEVER / 2) for x in pll.unpacked(pll.initial(v.shapes, v.prior), v.shapes)]
    total = 0.0
    for w in range(pll.EDGE):
        total += np.exp(pll.log_probabilities(p, v, np.array([pll.EDGE, pll.EDGE, 1, 2, w, 3, 4, pll.EDGE, pll.EDGE]))[2])
    assert total == pytest.approx(1, abs=1e-3)


def test_pseudo_likelihood_gradient_is_the_slope(spark):
    """A small step down the gradient changes the log-probability of its windows by the step times the squared gradient."""
    docs = spark.createDataFrame([(k, passage(k, 80)) for k in range(20)], "doc_id long, text string")
    v = pll.vocabulary(docs)
    ids, _ = v.ids([passage(k, 80).encode() for k in range(20)])
    at = np.flatnonzero(ids != pll.EDGE)
    around, step = np.stack([ids[at + o] for o in pll.WINDOW], axis=1), 1e-7
    p = [x.astype(np.float64) for x in pll.unpacked(pll.initial(v.shapes, v.prior), v.shapes)]
    p[4] += np.random.default_rng(0).normal(0, 0.3, p[4].shape)
    into = [np.zeros_like(x) for x in p]
    pll.gradient(p, v, around, ids[at], into)
    squared = sum((x * x).sum() for x in into)
    after = [x - step * g for x, g in zip(p, into, strict=True)]
    gained = (pll.log_probabilities(after, v, ids) - pll.log_probabilities(p, v, ids)).sum()
    assert gained == pytest.approx(squared * step, rel=0.02)


def test_pseudo_likelihood_context_decides_within_a_class(spark):
    """Of two words that are equally frequent, and so of one class, each stands in its own surroundings."""
    rng = np.random.default_rng(4)
    text = " ".join(f"a{k} b{k} w{k} c{k} d{k}" for k in rng.integers(0, 40, 12_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
    v = pll.vocabulary(docs)
    assert v.kind[v.words[b"w3"]] == v.kind[v.words[b"w4"]] or len({int(v.kind[v.words[b"w%d" % k]]) for k in range(40)}) < 40
    vocab = spark.sparkContext.broadcast(v)
    p = pll.unpacked(pll.train(pll.numbered(docs, vocab), vocab, passes=6).astype(np.float32), v.shapes)
    own, _ = v.ids([b"a3 b3 w3 c3 d3"])
    other, _ = v.ids([b"a3 b3 w4 c3 d3"])
    assert pll.log_probabilities(p, v, own)[2] > pll.log_probabilities(p, v, other)[2] + 1


def test_pseudo_likelihood_trains_on_every_window(spark):
    cycle = [f"w{k}".encode() for k in range(16)]
    docs = spark.createDataFrame([(1, " ".join(w.decode() for w in cycle * 3000))], "doc_id long, text string").coalesce(1)
    v = pll.vocabulary(docs)
    vocab = spark.sparkContext.broadcast(v)
    p = pll.unpacked(pll.train(pll.numbered(docs, vocab), vocab, passes=3).astype(np.float32), v.shapes)
    ids, n = v.ids([b" ".join(cycle * 4)])
    found = pll.log_probabilities(p, v, ids)[16:32]  # a period of 16: a stride of 16 leaves most words no target
    assert n.tolist() == [64] and found.min() > np.log(0.2)


def test_pseudo_likelihood_does_not_depend_on_tasks(spark):
    """Held-out likelihood beats the counts alone by the same amount for one task and for many."""
    sf = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(sf):
        pytest.skip("no test data")
    docs = spark.read.parquet(sf).select("doc_id", "text")
    v = pll.vocabulary(docs)
    vocab = spark.sparkContext.broadcast(v)
    ids, _ = v.ids([r.text.encode() for r in docs.where("doc_id % 10 = 0 and text is not null").collect()])
    held = lambda flat: float(pll.log_probabilities(pll.unpacked(flat, v.shapes), v, ids).mean())
    learnt = pll.numbered(docs.where("doc_id % 10 <> 0"), vocab)
    one, many = (pll.train(learnt.repartition(n), vocab) for n in (1, 32))
    counts, a, b = held(pll.initial(v.shapes, v.prior)), held(one), held(many)
    assert a > counts + 0.15 and abs(a - b) < 1e-3


def test_pseudo_likelihood_gives_each_rare_word_its_own_probability(spark, monkeypatch):
    # 6,000 words seen once or thrice follow 8,192 frequent ones: they share buckets, not a probability
    rows = [(k, " ".join(f"f{j} " * 4 for j in range(32 * k, 32 * k + 32))) for k in range(256)]
    rows += [(1000 + k, " ".join(f"once{j}" for j in range(50 * k, 50 * k + 50))) for k in range(60)]
    rows += [(2000 + k, " ".join(f"thrice{j}" for j in range(50 * k, 50 * k + 50))) for k in range(60) for _ in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {bytes(r.word): r.n for r in pll.counted(docs).collect()}
    v = pll.vocabulary(docs)
    assert len(counts) == 14_192 and sum(counts.values()) == 32_768 + 3000 + 9000
    assert v.buckets.sum() == sum(c for w, c in counts.items() if w not in v.words) > 0
    p = pll.unpacked(pll.initial(v.shapes, v.prior), v.shapes)
    words = list(counts)
    total = 0.0
    for w in words:
        ids, _ = v.ids([w])
        own = np.log(counts[w] / v.buckets[ids[2] - pll.WORDS]) if pll.WORDS <= ids[2] < pll.EDGE else 0.0
        total += np.exp(pll.log_probabilities(p, v, ids)[0] + own)
    assert total == pytest.approx(1, abs=1e-3)
    one = docs.where("doc_id in (1000, 2000)")
    monkeypatch.setattr(pll, "train", lambda *a, **b: pll.initial(v.shapes, v.prior))
    monkeypatch.setattr(pll, "counted", lambda *a, **b: docs.sparkSession.createDataFrame([(bytearray(w), c) for w, c in counts.items()], "word binary, n bigint"))
    for r in pll.score(one).collect():
        ws = r.text.encode().split()
        ids, _ = v.ids([r.text.encode()])
        base = pll.log_probabilities(p, v, ids)
        at = ids[ids != pll.EDGE]
        want = sum(x + (np.log(counts[w] / v.buckets[i - pll.WORDS]) if w not in v.words else 0) for x, w, i in zip(base, ws, at, strict=True))
        assert r.log_likelihood == pytest.approx(want, rel=1e-5)


def test_pseudo_likelihood_vocabulary_grows(spark):
    docs = spark.range(1_012_000, numPartitions=2).selectExpr("id as doc_id", "concat('w', id % 6000, ' v', id) as text")
    v = pll.vocabulary(docs)
    assert len(v.words) == 6000 and len(v.starts) - 1 > pll.CLASSES and v.buckets.sum() == 1_012_000


def der(*parts):
    body = b"".join(b"\x02" + bytes([len(x)]) + x for x in parts)
    return b"\x30" + (bytes([len(body)]) if len(body) < 128 else b"\x81" + bytes([len(body)])) + body


def test_secret_spans(spark):
    b64 = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    jwt = f"{b64(json.dumps({'alg': 'HS256'}).encode())}.{b64(json.dumps({'sub': 'someone'}).encode())}.abc"
    key = base64.b64encode(der(bytes(range(1, 40)), b"\x01\x00\x01")).decode()
    not_key = base64.b64encode(bytes(range(60))).decode()
    hexkey = der(bytes(range(1, 40)), b"\x01\x00\x01").hex()
    ssh = base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(32)))).decode()
    kinds = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.find(t)]
    assert kinds(f"x {jwt} y") == ["jwt"] and kinds(f"k {key}") == ["der"] and kinds(f"k {not_key}") == []
    assert kinds(f"h {hexkey}") == ["hex", "der"] and kinds(f"s {ssh}") == ["ssh"]
    assert kinds("AKIA" + "A" * 12) == ["access"] and kinds("AKIA" + "A" * 11) == []
    assert secrets.find("é Api_Key' : \"abcdefgh\" token=short") == [(2, 0, 22)]
    docs = spark.createDataFrame([(1, "é password=hunter2hunter ok"), (2, None), (3, "")], "doc_id int, text string")
    got = {r.doc_id: r for r in secrets.mask(secrets.scan(docs)).select("doc_id", "text", secrets.listed("spans").alias("s")).collect()}
    assert (got[1].s, got[1].text) == ("assign:2:24", "é [SECRET] ok") and got[2].s == "" and got[2].text is None


def test_html_layout():
    page = "<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul><p>one<p>two <b>bold</b>, x<table><tr><td>a<td>bbbb<tr><th>cccc<td>d</table><div style='display: none'>no</div><p hidden>no</p><pre> x\n  y</pre>A&amp;B<br>c"
    assert html_text.to_text(page) == "- a\n- b\n  3. x\n  4. y\n\none\n\ntwo bold, x\n\na    | bbbb\ncccc | d\n\n x\n  y\n\nA&B\nc"
    assert html_text.to_text("") == "" and html_text.to_text("<p>open <b>bold") == "open bold" and html_text.to_text("<div>" * 5000 + "deep") == "deep"
    assert html_text.to_text("<script>var a='</p>'</script>x<!-- y") == "x"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><form><tr><td>a<td>b</tr><tr><td>c<td>d</tr></form></table>", "a | b\nc | d"),
        ("<table><tbody><div><center><tr><td>a</td></tr></center></div></tbody></table>", "a"),
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a | b"),
        ("<table><tr><a href=x><td>a</td></a></tr></table>z", "a\n\nz"),
        ("<table>stray <b>bold</b><tr>more<td>cell</td></tr><p>para</p></table>", "stray boldmore\n\npara\n\ncell"),
        ("<table><form><p>label</p><tr><td>a</td></tr></form></table>", "label\n\na"),
        ("<table><tr><td><table><form><tr><td>in</td></tr></form></table></td><td>out</td></tr></table>", "in | out"),
        ("<table><tr hidden><td>no</td></tr><form hidden><tr><td>no</td></tr></form><tr><td>yes</td></tr></table>", "yes"),
        ("<head><title>x</title><h1>Heading</h1><p>text", "Heading\n\ntext"),
        ("<html><head><meta charset=utf-8><script>var a</script>words<b> bold</b>", "words bold"),
        ("<head><template><div>no</div></template><title>no</title></head><body>yes", "yes"),
        ("<p>a <span aria-hidden='true'>shown</span>", "a shown"),
        ("<table><tr><td colspan='²'>a<td colspan=2x>b<td colspan=-1>c</table>", "a | b | c"),
        ("<div>" * 300 + "<span hidden>SECRET</span>seen" + "</div>" * 300 + "<p>after", "seen\n\nafter"),
        ("<div>" * 50_000 + "<b hidden>no</b>deep" + "</div>" * 50_000, "deep"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no<table><tr><td>no<td style='visibility:visible'>cell</table></div>", "yes\n\n | cell"),
        ("<p style='display:none; display:block'>yes<p hidden style='display:block'>yes", "yes\n\nyes"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
        ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
        ("a <b title='x > y'>b</b> 1 < 2 </nothing> c", "a b 1 < 2 c"),
        ("a<!-->b<!-- no --!>c<!--- x -->d<?php no ?>e<![CDATA[<f>]]>", "abcde<f>"),
        ("<script>a</scripty>no</script >yes", "yes"),
        ("<svg><title>no</title><text>x</text><text>y</text></svg>", "x y"),
        ("a<b title=\"never closed>b</b> c", "a"),
        ("<pre>\n x\n</pre>", " x"),
        ("<ul>" + "<li>a<ul>" * 40 + "<li>last", None),
        ("<table><tr><td>x" * 60, None),
    ],
)
def test_html_text_is_whole(page, text):
    got = html_text.to_text(page)
    assert got == text if text is not None else (got.count("a"), got.count("last")) == (41, 1) or got.count("x") == 60


@pytest.mark.parametrize("piece", ["<a href=\"x", "<a href='x' b", "<div>", "<b>", "</b>", "<p>", "<td>", "<table><tr><td>", "<li>", "<ul><li>", "<!", "<!--", "<", "&amp", "<script>", "<td colspan=100 rowspan=0>x", "<x =", "<select><option>"])
def test_html_text_time_grows_with_the_length(piece):
    import time

    began = time.process_time()
    html_text.to_text(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 30


def test_html_rows_awkward(spark):
    docs = spark.createDataFrame([], "page_id int, html string, TEXT int")
    assert html_text.extract(docs).count() == 0
    row = html_text.extract(spark.createDataFrame([(1, "<p>a", 5)], "page_id int, html string, TEXT int")).first()
    assert row.asDict() == {"page_id": 1, "html": "<p>a", "text": "a"}


def test_quality_tokens_do_not_depend_on_the_batch(spark):
    both = quality.Tokens().of([b"one same", b"", None, b"Same same end"])
    alone = [quality.Tokens().of([t]) for t in (b"one same", b"Same same end")]
    assert both[1].tolist() == [x for a in alone for x in a[1].tolist()] and both[2].tolist() == [2, 0, 0, 3]


def test_quality_neighbours_across_slices(spark):
    # one text of two slices; its words at the border are met there only
    words = ["fill"] * (quality.SLICE - 1) + ["left", "right"] + ["fill"] * 10
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    core, shape, _ = quality.Tokens().of([" ".join(words).encode()])
    index, k = quality.index_vectors(), quality.SLICE - 1
    want = sum(index[core[j]] + index[shape[j]] for j in (k - 1, k, k + 1))
    assert quality.word_vectors(docs)[core[k]] == pytest.approx(want / np.linalg.norm(want), abs=1e-5)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (2, None), (3, ""), (1, "<p>a")], "page_id int, html string")
    assert sorted((r.page_id, r.text or "") for r in html_text.extract(pages).collect()) == [(1, "a"), (1, "a"), (2, ""), (3, "")]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(200):
        good = k % 4 != 0
        rows.append((k, " ".join(f"w{j}" if good else f"W{j}!!" for j in rng.integers(0, 500, 60)), "en", "s", 0))
        labels.append((k, int(good), 0))
    item = passage(77, 30)
    rows += [(500, rows[1][1], "en", "s", 0), (501, item, "en", "s", 0), (502, f"{passage(78, 600)} {item} tail", "en", "s", 0), (503, f"{passage(79, 60)} password=hunter2hunter2", "en", "s", 0), (504, None, "en", "s", 0), (505, "", "en", "s", 0)]
    for name, df in (
        ("documents", spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame([(1, item)], "item_id int, text string")),
    ):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in cp.keep_good(spark, docs, str(tmp_path)).collect()}
    assert len([k for k in range(200) if (k in kept) != (k % 4 != 0)]) < 10
    unique = cp.drop_near_duplicates(spark, docs, str(tmp_path))
    assert {r.doc_id for r in unique.collect()} == {r[0] for r in rows} - {500} and unique.columns == list(cp.COLUMNS)
    clean = {r.doc_id: r for r in cp.decontaminate_benchmark(spark, docs, str(tmp_path)).collect()}
    assert 501 not in clean and item not in clean[502].text and clean[502].n_chars == len(clean[502].text) and len(clean) == len(rows) - 1
    masked = {r.doc_id: r.text for r in cp.mask_secrets(spark, docs, str(tmp_path)).collect()}
    assert masked[503].endswith("[SECRET]") and len(masked) == len(rows)
    last = cp.run(spark, str(tmp_path)).collect()
    assert last and all(r.round_trip and len(r.ids) == r.n_tokens for r in last)


def test_digest_of_ids_matches_contract(spark):
    df = spark.createDataFrame([([5, 6, 70],), ([],)], "ids array<int>")
    got = [r.s for r in df.select(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("s")).collect()]
    assert got == [hashlib.sha256(x).hexdigest() for x in (b"5,6,70", b"")]

"""The pipeline against a plain version of all its stages, and rendered pages against a walk over the tree they came from."""

from __future__ import annotations

import base64
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import html_text

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def grams(t):
    words = WORD.findall(lower(t or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else None


def without_near_copies(rows):
    """The row of least id of each group that links of 0.8 or more join; equal rows once; texts without words all."""
    rows = list(dict.fromkeys(rows))
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                group[max(find(i), find(j))] = min(find(i), find(j))
    heads = {}
    for i, (doc, _) in enumerate(rows):
        key = find(i) if sets[i] else ("alone", i)
        heads[key] = min(heads.get(key, (True, 0, 0)), (doc is None, doc, i)) if key in heads else (doc is None, doc, i)
    return [rows[i] for _, _, i in sorted(heads.values(), key=lambda h: h[2])]


def without_benchmark(t, items):
    """None if hits are a twentieth or more of the words; else the text without its hit runs."""
    spans, hit = [m.span() for m in WORD.finditer(lower(t or ""))], set()
    words = [lower(t)[a:b] for a, b in spans]
    for item in items:
        own = WORD.findall(lower(item))
        n = min(13, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
        for k in range(len(words) - n + 1):
            if n and tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
    if hit and 20 * len(hit) >= len(words):
        return None
    out, at = "", 0
    for k in sorted(hit):
        if k - 1 not in hit:
            out += t[at : spans[k][0]]
        at = spans[k][1]
    return out + t[at:] if t else t


def test_pipeline_against_plain_stages(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    import corpus_pipeline as cp

    rng, rows, labels = random.Random(4), [], []
    text = lambda n, of=600: [f"w{rng.randrange(of)}" for _ in range(n)]
    item = " ".join(text(30, 90))
    for k in range(150):
        good = k % 5 != 0
        words = text(60)
        rows.append((k, " ".join(w if good else w.upper() + "!!" for w in words)))
        labels.append((k, int(good), 0))
        if k % 11 == 1:
            rows.append((1000 + k, " ".join([*words[:-1], "changed"])))  # a near copy
        if k % 13 == 2:
            rows.append((2000 + k, " ".join([*text(500), item, *text(120)])))  # a short passage in a long text
        if k % 17 == 3:
            rows.append((3000 + k, " ".join([*text(20), item.upper()])))  # mostly the passage
        if k % 7 == 4:
            rows.append((4000 + k, " ".join([*words, "password=hunter2hunter2", *text(9), "AKIA" + "A" * 16])))
    rows += [rows[4], rows[4], (None, "no id " + " ".join(text(40)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "w1 w2 w3 w4 w5 w6 w7")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = [(r.doc_id, r.text) for r in cp.keep_good(spark, read, str(tmp_path)).orderBy(F.col("doc_id").asc_nulls_last()).collect()]
    assert 100 < len(good) < len(rows)
    want = []
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    code = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for doc, t in without_near_copies(good):
        clean = without_benchmark(t, [item, "w1 w2 w3 w4 w5 w6 w7"])
        if clean is not None:
            masked = re.sub(r"password=[A-Za-z0-9+/_.=-]{8,}|AKIA[A-Z0-9]{12,}", "[SECRET]", clean)
            want.append((doc, code.encode_ordinary(masked), True))
    last = cp.run(spark, str(tmp_path))
    got = [(r.doc_id, list(r.ids), r.round_trip) for r in last.collect()]
    folder = os.path.dirname(os.path.dirname(last.inputFiles()[0].removeprefix("file://")))
    assert os.listdir(folder) == ["4-tokens"]
    assert sorted(got, key=str) == sorted(want, key=str)


BLOCK, INLINE = ["div", "p", "section", "blockquote", "h2"], ["b", "i", "span", "a", "em"]


def tree(rng, depth, counter, shown=True):
    """(mark-up, visible words in order) of a random well-formed piece."""
    parts, words = [], []
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["text", "text", "inline", "block", "list", "table", "void", "raw"]) if depth else "text"
        if kind == "text":
            w = [f"v{next(counter)}" for _ in range(rng.randint(1, 3))]
            parts.append(" " + " ".join(w) + rng.choice(["", " &amp; ", "\n"]) + " ")
            words += w if shown else []
            continue
        if kind == "void":
            parts.append(rng.choice(["<br>", "<hr>", "<img src=x alt=no>", "<!-- no -->"]))
            continue
        if kind == "raw":
            parts.append(rng.choice(["<script>var no = '<p>no</p>';</script>", "<style>no {}</style>", "<template><p>no</template>"]))
            continue
        hidden = rng.random() < 0.2
        attrs = rng.choice([" hidden", " style='display:none'"]) if hidden else rng.choice(["", " class=x"])
        if kind in ("inline", "block"):
            tag = rng.choice(INLINE if kind == "inline" else BLOCK)
            # a block within p would end it, so p holds text alone
            inner, own = tree(rng, 0 if tag in ("p", "h2") or kind == "inline" else depth - 1, counter, shown and not hidden)
            parts.append(f"<{tag}{attrs}>{inner}</{tag}>")
        else:
            inner, own = "", []
            for _ in range(rng.randint(1, 3)):
                cell, more = tree(rng, depth - 1, counter, shown and not hidden)
                inner += f"<li>{cell}</li>" if kind == "list" else f"<tr><td>{cell}</td></tr>"
                own += more
            tag = rng.choice(["ul", "ol"]) if kind == "list" else "table"
            parts.append(f"<{tag}{attrs}>{inner}</{tag}>")
        words += own
    return "".join(parts), words


@pytest.mark.parametrize("seed", range(300))
def test_all_visible_words_in_order(seed):
    import itertools

    rng, counter = random.Random(seed), itertools.count()
    page, words = tree(rng, 4, counter)
    assert re.findall(r"v\d+", html_text.to_text(f"<html><head><title>no</title></head><body>{page}</body></html>")) == words
    assert "no" not in html_text.to_text(page).split()

"""SentencePiece coding against the library, on every kind of text and through Spark."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import piece_bpe, queries

P = pytest.importorskip("public_tokenizers")
S = pytest.importorskip("sentencepiece")
PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return S.SentencePieceProcessor(model_file=PATH)


def texts():
    rng, pieces = random.Random(5), piece_bpe.vocabulary(PATH).pieces[259:]
    odd = [" ", "  ", "\n", "\t", "▁", "a", "e", "th", "1", "23", ".", "ß", "中", "文", "ا", "🙂", "\u0301", "\x00", "<s>", "</s>", "<0x0A>", "the", "ing", "\u3000", "\r"]
    make = lambda of, n, keep: "".join(rng.choice(of).replace("▁", keep) for _ in range(rng.randint(0, n)))
    yield from ("", " ", "▁", "\n", " " * 15, " " * 16, "x" * 5000, " " * 60_000 + "a", "ab" * 3000 + " " + "long words " * 20_000)
    yield from (" " * n + w for n in range(60) for w in ("", "a", "中", "\n", "🙂"))
    for _ in range(3000):
        yield make(odd, 50, "▁")
        yield make(pieces, 25, " ")
        yield make(pieces, 40, "")  # one long word
        yield "".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(1, 200)))
        yield "".join(map(chr, rng.choices([*range(0x3000), *range(0xE000, 0x11000)], k=20)))


def test_ids_and_texts_are_the_librarys(library):
    every = list(texts())
    encoder = piece_bpe.Encoder(PATH)
    for low in range(0, len(every), 512):
        part = every[low : low + 512]
        ids, cuts = encoder.encode([t.encode() for t in part])
        back = encoder.texts(ids, cuts).to_pylist()
        for k, want in enumerate(library.encode(part, add_eos=True)):
            assert ids[cuts[k] : cuts[k + 1]].tolist() == want, part[k][:80]
            assert back[k] == library.decode(want), part[k][:80]


def test_words_that_are_forgotten_are_coded_again(monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "KEPT_WORDS", 3)
    encoder = piece_bpe.Encoder(PATH)
    for t in ("one two three four", "four five", "one two", "six one"):
        assert encoder.encode([t.encode()])[0].tolist() == library.encode(t, add_eos=True)


def test_any_ids_decode_as_the_library_does(library):
    model, rng = piece_bpe.vocabulary(PATH), random.Random(2)
    for _ in range(2000):
        ids = [rng.choice((rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000), 28705, 1, 2)) for _ in range(rng.randint(0, 12))]
        assert piece_bpe.text_of(ids, model, model.raw) == library.decode(ids), ids
    with pytest.raises(ValueError, match="vocabulary"):
        piece_bpe.text_of([32000], model, model.raw)


def test_query_and_awkward_rows(spark, tmp_path, library):
    rows = [(None, "no id"), (1, None), (2, ""), (3, " \n\t!! "), (4, "repeat me"), (4, "repeat me"), (5, "Ünï 👩‍👩‍👧 ½ 一二 <s>"), (6, "long words " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("IDS", F.lit("clash")).withColumn("decoded", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_sentencepiece(spark, str(tmp_path)).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=str)
    coded = piece_bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "decoded", "ids"]
    back = piece_bpe.decode(coded, PATH)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    none = spark.createDataFrame([], "doc_id long, text string")
    assert piece_bpe.decode(piece_bpe.encode(none, PATH, decoded="d"), PATH).count() == 0
    assert np.array_equal(piece_bpe.vocabulary(PATH).encode_words(["▁a"])[1], [1])

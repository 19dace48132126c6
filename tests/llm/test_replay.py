"""A replay by ranges of ranks gives what one by single ranks gives, in fewer turns."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerline.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers as P

    return bpe.rank_table(P.path("byte_bpe_multi_50k.tiktoken"))


def words(n, longest, seed=5):
    rng = random.Random(seed)
    return [bytes(rng.choice(b"abcdeinorst 'XY0") for _ in range(rng.randint(1, longest))) for _ in range(n)]


def test_ranges_of_ranks_change_nothing(ranks):
    merges, byte_ids = ranks
    symbols = bpe.symbols_of([*words(2000, 14), b"a" * 300, b"ababab" * 30, "é".encode() * 50, b" " * 77, *words(20, 400)], byte_ids)
    one = bpe.replay(symbols, merges)
    for width in (2, 64, bpe.RANGE, 1 << 20):
        np.testing.assert_array_equal(bpe.replay(symbols, merges, width), one)


def test_short_words_take_few_turns(ranks, monkeypatch):
    merges, byte_ids = ranks
    turns = []
    of = bpe.Merges.of
    monkeypatch.setattr(bpe.Merges, "of", lambda self, *a: turns.append(1) or of(self, *a))
    bpe.replayed(words(20_000, 14), merges, byte_ids)
    assert len(turns) < 500  # with a turn for each rank 1,519


def test_long_and_short_words_keep_their_order(ranks):
    import tiktoken

    merges, byte_ids = ranks
    mixed = [*words(50, 300, 6), *words(50, 10, 7)]
    random.Random(8).shuffle(mixed)
    assert {len(w) + 1 > bpe.LONG_WORD for w in mixed} == {True, False}
    import public_tokenizers as P

    lib = tiktoken.Encoding("own", pat_str="(?s:.)+", mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    ids, ends = bpe.replayed(mixed, merges, byte_ids)
    assert [x.tolist() for x in np.split(ids, ends)[: len(mixed)]] == [lib.encode_ordinary(w.decode()) for w in mixed] and ends[-1] == len(ids)
    assert [len(x) for x in bpe.replayed([], merges, byte_ids)] == [0, 0]

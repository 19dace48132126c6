"""Token counts with a whole-token shortcut.

Before any text is read, every vocabulary string is run through the merges; those that come out as one token are proven
whole. In texts a pre-token among them counts 1 at once, and only the others are merged.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.bpe import KEPT_WORDS, PAIR, Merges, Numbered, replay, symbols_of
from ledgerline.llm.characters import SPACE, composed, lowered, splitter
from ledgerline.llm.common import map_rows


@cache
def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Counted:
    """Reads a BPE tokenizer file whose normalizer is NFC, white-space runs to a space, then lower case."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or (split["behavior"], split["invert"]) != ("Removed", True):
            raise ValueError(f"{path}: another kind of tokenizer")
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        ranks = {vocab[a] * PAIR + vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.merges = Merges(ranks, [vocab[a + b] for a, b in model["merges"]])
        letters = byte_letters()
        self.first = [vocab[letters[b]] for b in range(256)]
        self.last = np.array([vocab[letters[b] + self.end] for b in range(256)])
        self.split = splitter(split["pattern"]["Regex"])
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)).split if special else lambda t: [t]
        self.runs = re.compile(f"[{SPACE}]+").sub
        self.whole = self._whole(vocab, {c: b for b, c in letters.items()})
        self._forget()

    def _forget(self) -> None:
        self.words, self.sizes = Numbered(), np.ones(len(self.whole), dtype=np.int32)
        self.words.of(self.whole, len(self.whole))

    def _sizes(self, words: list[str]) -> np.ndarray:
        """How many tokens the merges leave of each word; a word's last byte has the word's end in its symbol."""
        raw = [w.encode() for w in words]
        symbols = symbols_of(raw, self.first)
        last = np.cumsum([len(w) + 1 for w in raw]) - 2
        symbols[last] = self.last[[w[-1] for w in raw]]
        return np.diff(np.r_[-1, np.flatnonzero(replay(symbols, self.merges) == -1)]) - 1

    def _whole(self, vocab: dict[str, int], byte: dict[str, int]) -> list[str]:
        """The vocabulary strings that are one pre-token and come out of the merges as one token."""
        words = []
        for token in vocab:
            if token.endswith(self.end) and len(token) > len(self.end):
                try:
                    word = bytes(byte[c] for c in token.removesuffix(self.end)).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if self.split(word) == [word]:
                    words.append(word)
        return [w for w, n in zip(words, self._sizes(words).tolist(), strict=True) if n == 1]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text. Words proven whole have the numbers before all others, and a size of 1."""
        if len(self.words.numbers) > KEPT_WORDS:
            self._forget()
        out, words, n = np.zeros(len(texts), dtype=np.int64), [], []
        for k, t in enumerate(texts):
            parts = self.special(t) if t else [""]
            out[k] = len(parts) - 1
            found = []
            for part in parts:
                found += self.split(lowered(self.runs(" ", composed(part))))
            words.append(self.words.of(found, len(found)))
            n.append(len(found))
        if rest := self.words.since(len(self.sizes)):
            self.sizes = np.concatenate([self.sizes, self._sizes(rest).astype(np.int32)])
        ends = np.r_[0, np.cumsum(n)]
        total = np.r_[0, np.cumsum(self.sizes[np.concatenate(words)], dtype=np.int64)] if words else ends
        return out + total[ends[1:]] - total[ends[:-1]]


@cache
def counted(path: str) -> Counted:
    return Counted(path)


def count_tokens(docs: DataFrame, tokenizer_path: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_bytes (UTF-8) and n_tokens of each whole text, as the tokenizer's own library counts them.

    Strings of special tokens inside a text count one token each. Null and empty texts have 0 of both; each row is
    counted alone, so repeated rows give repeated results; columns of these names are replaced; an empty table gives an
    empty one. A very long text is a batch of its own and is counted whole.
    """

    def make():
        c = counted(tokenizer_path)
        return lambda texts: ([len(t or b"") for t in texts], pa.array(c.counts([t and t.decode() for t in texts])))

    return map_rows(docs, [text], "n_bytes bigint, n_tokens bigint", make, keep)

"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items are put into one automaton, item by item. Training words are streamed through it; after each
word the state holds the longest suffix that occurs in some item. A suffix of at least `window` words marks its last
`window` words as hit, and a whole shorter item marks itself.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import map_rows, shared_folder, words_of

#: Item words in one automaton, about. A larger benchmark is handled in several automata, one pass over the documents each.
WORDS_PER_AUTOMATON = 1_000_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """States of all substrings of the items, as parallel lists."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        ends: list[tuple[int, str | None, int]] = []  # (state of a window, its item, its words)
        for item, words in items:
            last, n = 0, len(words)
            size = min(window, n)
            for i, w in enumerate(words, 1):
                last = self._extend(last, w)
                if i >= size:
                    ends.append((last, item, size))
        # a window's own state: the one on the suffix path whose lengths include the window's
        self.items: dict[int, dict[int, set[str]]] = {}
        for state, item, size in ends:
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            names = self.items.setdefault(state, {}).setdefault(size, set())
            if item is not None:
                names.add(item)
        # the next state towards the root that ends a window, this one included
        self.near = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.near[state] = state if state in self.items else self.near[self.link[state]]

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:  # shared with an earlier item
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, length: int, nxt: dict[bytes, int]) -> int:
        self.next.append(nxt)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link = self.next, self.link
        copy = self._state(self.length[p] + 1, dict(nxt[q]))
        link[copy], link[q] = link[q], copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit runs [start, end) in order and disjoint, items with occurring windows, longest match."""
        nxt, link, length, near, items = self.next, self.link, self.length, self.near, self.items
        runs: list[list[int]] = []
        found: set[str] = set()
        seen: set[int] = set()
        state = matched = longest = 0
        for i, w in enumerate(words, 1):
            to = nxt[state].get(w)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = nxt[state].get(w)
                if to is None:
                    matched = 0
                    continue
                matched = length[state]
            state = to
            matched += 1
            if matched > longest:
                longest = matched
            at = near[state]
            most = 0
            while at > 0:
                for size, names in items[at].items():
                    if size <= matched:
                        most = max(most, size)
                        if (at, size) not in seen:
                            seen.add((at, size))
                            found |= names
                at = near[link[at]] if link[at] > 0 else -1
            if most:
                start = i - most
                while runs and runs[-1][0] >= start:
                    runs.pop()
                if runs and runs[-1][1] >= start:
                    runs[-1][1] = i
                else:
                    runs.append([start, i])
        return [(a, b) for a, b in runs], found, longest


def dealt(benchmark: DataFrame, item: str, text: str, words_per_automaton: int) -> tuple[DataFrame, int]:
    """The different items (i, t) with their block, and the number of blocks, each of about that many words at most."""
    word = r"[0-9A-Za-z\x{80}-\x{10ffff}]+"
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null").distinct()
    words = rows.agg(F.sum(F.regexp_count("t", F.lit(word)))).first()[0] or 0
    parts = -(-words // words_per_automaton)
    parts += parts // 2 * (parts > 1)  # room for uneven blocks
    return rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(max(parts, 1)))), parts


def _without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The bytes of the text without its hit runs, and what stands between the words of a run."""
    spans = [m.span() for m in _WORD.finditer(text)]
    parts, at = [], 0
    for start, end in runs:
        parts.append(text[at : spans[start][0]])
        at = spans[end - 1][1]
    return b"".join([*parts, text[at:]])


def _merged(a: list, b: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted([*map(tuple, a), *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    words_per_automaton: int = WORDS_PER_AUTOMATON,
    clean: str | None = None,
) -> DataFrame:
    """docs with n_words, hits (array of word runs [start, end)), n_hit, items (sorted ids) and longest_match.

    Null and empty texts have no words and no hits; items without words match nothing; an item of a null id hits words
    but is not listed. Each row is judged alone, so repeated rows give repeated results; added columns replace input
    columns of the same names; an empty benchmark or an empty docs gives no hits or no rows. A text of any length is
    streamed through the automaton word by word. clean: a column for the text without its hit runs, as by cut_hits().

    The driver and a task hold the items of one automaton, about words_per_automaton words. Of a larger benchmark each
    block goes over the texts by itself and keeps numbers and runs alone, no text; these are joined to the rows once, by
    their numbers. docs must then be rows that are the same, in the same order, whenever they are read, as a table's are.
    """
    spark = docs.sparkSession
    added = {"n_words", "hits", "n_hit", "items", "longest_match", "__row", "__parts"}
    first = docs.drop(*(c for c in docs.columns if c.lower() in added))
    ddl = "n_words bigint, hits array<struct<start:int,end:int>>, items array<string>, longest_match int"
    rows, parts = dealt(benchmark, item, item_text, words_per_automaton)
    with_clean = ddl + (f", `{clean}` string" if clean else "")

    def cleaned(t: bytes | None, runs: list[tuple[int, int]]) -> str | None:
        return None if t is None else (_without(t, runs) if runs else t).decode()

    def one_pass(df: DataFrame, block: Broadcast, clean: str | None, keep: list[str] | None = None) -> DataFrame:
        def make():
            automaton = SuffixAutomaton(((i, words_of(t)) for i, t in block.value), window)

            def work(texts):
                out = ([], [], [], [], [])
                for t in texts:
                    words = words_of(t)
                    runs, found, longest = automaton.matches(words)
                    for to, value in zip(out, (len(words), [{"start": a, "end": b} for a, b in runs], sorted(found), longest), strict=False):
                        to.append(value)
                    if clean:
                        out[4].append(cleaned(t, runs))
                return out if clean else out[:4]

            return work

        return map_rows(df, [text], with_clean if clean else ddl, make, keep)

    def together(df: DataFrame) -> DataFrame:
        """The blocks' results of each row as one."""

        def make():
            def work(texts, parts):
                out = ([], [], [], [], [])
                for t, found in zip(texts, parts, strict=True):
                    runs: list[tuple[int, int]] = []
                    for x in found or ():
                        runs = _merged([(h["start"], h["end"]) for h in x["hits"]], runs)
                    out[0].append(len(words_of(t)))
                    out[1].append([{"start": a, "end": b} for a, b in runs])
                    out[2].append(sorted({i for x in found or () for i in x["items"]}))
                    out[3].append(max((x["longest_match"] for x in found or ()), default=0))
                    out[4].append(cleaned(t, runs) if clean else None)
                return out if clean else out[:4]

            return work

        return map_rows(df, [text, "__parts"], with_clean, make, [c for c in df.columns if not c.startswith("__")])

    def block(n: int) -> Broadcast:
        return spark.sparkContext.broadcast([(r.i, r.t.encode()) for r in rows.where(F.col("part") == n).toLocalIterator()])

    if parts <= 1:
        found = one_pass(first, block(0), clean)
    else:
        numbered = first.withColumn("__row", F.monotonically_increasing_id())
        to = f"{shared_folder(spark)}/overlaps-{uuid.uuid4().hex}"
        for n in range(parts):
            narrow = one_pass(numbered.select("__row", text), block(n), None, ["__row"]).where("longest_match > 0")
            narrow.select("__row", F.struct("hits", "items", "longest_match").alias("x")).write.parquet(f"{to}/part={n}")
        met = spark.read.parquet(to).groupBy("__row").agg(F.collect_list("x").alias("__parts"))  # one of each block at the most
        found = together(numbered.join(met, "__row", "left"))
    return found.withColumn("n_hit", F.expr("aggregate(hits, 0L, (a, h) -> a + h.end - h.start)"))


def contaminated(coverage: int = 20) -> Column:
    """Whether hit words are at least one in `coverage` words."""
    return (F.col("n_hit") > 0) & (F.lit(coverage) * F.col("n_hit") >= F.col("n_words"))


def cut_hits(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Removes the hit word runs of find_overlaps() from the text, with what stands between a run's words. Null stays null."""

    def make():
        def work(texts, hits):
            return ([None if t is None else (_without(t, [(r["start"], r["end"]) for r in runs]) if runs else t).decode() for t, runs in zip(texts, hits, strict=True)],)

        return work

    return map_rows(df, [text, "hits"], f"`{text}` string", make)

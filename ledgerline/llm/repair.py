"""Conversation structure repair at least cost over a suffix-shared DAWG.

A conversation's rows become a signature, a letter a row: its role, or that it must go, and whether it is cut off. Spark
deals signatures by ranges of their reversed letters, so that those with an end in common stand next to each other. The
automaton's nodes are their suffixes: along a range each is made once, whatever the number of conversations that share
it, and holds for every state of the role grammar the cost to go and the first edits of the best audit, which leads to
the next node. Nodes whose costs differ by a constant share their edits; what is held at a time is one path of nodes.

The cheapest edits are then applied in one pass over the texts, dealt and sorted by conversation. A conversation is
streamed in order, never held: only its signature and audit, a byte a row, are in memory at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import counted_memory, limit_batches, shared

#: White space of texts: a text of nothing else is blank.
SPACE = " \t\n\v\f\r"
#: Costs of the edits, and of a row that stays although it is cut off.
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
#: The role grammar (s?(ua)+)?: its states are 0 at the start, and 1, 2, 3 after s, u, a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
#: What an added or changed row becomes in each state.
NEXT_ROLE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
#: Letters of a signature: s, u, a, x (no such role), large if cut off, and - for a row that must go.
MUST_GO, OTHER = "-", "x"

Moves = tuple[tuple[str, int], ...]


@dataclass(frozen=True)
class Node:
    """Costs to go by grammar state, above the least of them; the edits up to and with this row; the state after it."""

    costs: tuple[int, ...]
    moves: Moves


def _with_inserts(plain: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """(cost, edits, state after) of each state, where rows may be added first; the audit's least letter decides ties."""
    best = list(plain)
    for _ in plain:
        added = [(INSERT + best[t][0], "I" + best[t][1], best[t][2]) for t in (STEPS[q, NEXT_ROLE[q][0]] for q in range(4))]
        best = [min(a, b) for a, b in zip(plain, added, strict=True)]
    return best


def _node(best: list[tuple[int, str, int]]) -> tuple[int, Node]:
    least = min(c for c, _, _ in best)
    return least, Node(tuple(c - least for c, _, _ in best), tuple((edits, q) for _, edits, q in best))


class Automaton:
    """Nodes are made once for each letter and following costs, and shared by all suffixes that come to the same."""

    def __init__(self) -> None:
        never = (1 << 30, "~", 0)
        self.end = _node(_with_inserts([(0, "", q) if q in FINAL else never for q in range(4)]))
        self.made: dict[tuple[tuple[int, ...], str], tuple[int, Node]] = {}

    def before(self, letter: str, after: Node) -> tuple[int, Node]:
        """The node of a row followed by `after`, and by how much its least cost is higher."""
        key = (after.costs, letter)
        if (found := self.made.get(key)) is None:
            found = self.made[key] = _node(_with_inserts([min(self._edits(letter, after.costs, q)) for q in range(4)]))
        return found

    @staticmethod
    def _edits(letter: str, costs: tuple[int, ...], q: int) -> Iterator[tuple[int, str, int]]:
        yield DELETE + costs[q], "D", q
        if letter != MUST_GO:
            stays = CUT_OFF if letter.isupper() else 0
            if (to := STEPS.get((q, letter.lower()))) is not None:
                yield stays + costs[to], "K", to
            to = STEPS[q, NEXT_ROLE[q][0]]
            yield stays + REROLE + costs[to], "R", to


class Suffixes:
    """The path of nodes of one reversed signature; the next one keeps what it shares with it."""

    def __init__(self) -> None:
        self.automaton = Automaton()
        least, node = self.automaton.end
        self.signature, self.path, self.least = "", [node], [least]

    def best(self, reversed_signature: str) -> tuple[int, str]:
        """(cost, audit) of the cheapest edits, the ASCII-least of equal ones."""
        shared_length = _common(self.signature, reversed_signature)
        del self.path[shared_length + 1 :], self.least[shared_length + 1 :]
        for letter in reversed_signature[shared_length:]:
            more, node = self.automaton.before(letter, self.path[-1])
            self.path.append(node)
            self.least.append(self.least[-1] + more)
        self.signature = reversed_signature
        q, audit = 0, []
        for node in reversed(self.path):
            edits, q = node.moves[q]
            audit.append(edits)
        return self.least[-1] + self.path[-1].costs[0], "".join(audit)


def _common(a: str, b: str) -> int:
    """Length of what two strings begin with together."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _print(role: Column, text: Column) -> Column:
    """128 bits of a row's role and text, by which equal rows are known."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), there(role).alias("role"), there(text).alias("text"))


def signatures(rows: DataFrame, every: DataFrame | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, signature of each conversation of rows, and of `every` if given."""
    own = _rows(rows, conv, turn, role, text)
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    narrow = own.select("conv", "turn", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"), _print(F.col("role"), F.col("text")).alias("h"), F.lit(True).alias("real"))
    if every is not None:
        ids = every.select(F.col(conv).alias("conv")).distinct()
        narrow = narrow.unionByName(ids.withColumn("real", F.lit(False)), allowMissingColumns=True)
    # of rows equal in all, the one that is no repetition comes first
    order = [F.col("turn").asc_nulls_first(), "h", "again"]
    same = Window.partitionBy("conv", "real", "h").orderBy(F.col("turn").asc_nulls_first())
    inside = Window.partitionBy("conv", "real").orderBy(*order)
    pair = F.concat(F.lag("initial").over(inside), "initial")
    dealt = narrow.repartition("conv").withColumn("again", F.row_number().over(same) > 1)
    marked = dealt.select(
        "conv", "real", "turn", "h", "initial", "blank", "again", "open",
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).cast("byte").alias("illegal"),
        F.coalesce(F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(inside)), F.lit(False)).cast("byte").alias("fresh"),
        (F.row_number().over(Window.partitionBy("conv").orderBy("real", *order)) == 1).alias("first"),
    )
    role_letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(OTHER)
    mark = (
        F.when(~F.col("real"), " ").when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("open"), F.upper(role_letter)).otherwise(role_letter)
    )  # b and d are both rows that must go; apart they are counted
    fed = marked.sortWithinPartitions("conv", "real", *order).select("conv", "first", "turn", mark.alias("mark"), "illegal", "fresh")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]
        kind, held = None, None

        def out(done: list[list]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [kind, *[pa.int64()] * 5, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def finished(h: dict) -> list:
            s = b"".join(h["marks"])
            signature = s.translate(_MUST_GO, b" ").decode()
            gaps = 0 if h["low"] is None else h["high"] - h["low"] + 1 - h["fresh"]
            return [h["conv"], gaps, s.count(b"b"), s.count(b"d"), sum(map(s.count, (b"S", b"U", b"A", b"X"))), h["illegal"], signature]

        with counted_memory():
            for b in batches:
                if not b.num_rows:
                    continue
                kind = b.schema.field(0).type
                first = np.asarray(b.column(1).to_numpy(zero_copy_only=False), dtype=bool)
                starts = np.flatnonzero(first)
                cuts = np.unique(np.r_[0, starts])
                ends = np.r_[cuts[1:], b.num_rows]
                marks, convs = "".join(b.column(3).to_pylist()).encode(), b.column(0).take(pa.array(cuts)).to_pylist()
                turns = b.column(2)
                known = np.asarray(turns.is_valid())
                values = turns.fill_null(0).to_numpy(zero_copy_only=False)
                low = np.minimum.reduceat(np.where(known, values, np.iinfo(np.int64).max), cuts)
                high = np.maximum.reduceat(np.where(known, values, np.iinfo(np.int64).min), cuts)
                some = np.logical_or.reduceat(known, cuts)
                illegal, fresh = (np.add.reduceat(b.column(i).to_numpy().astype(np.int64), cuts) for i in (4, 5))
                done = []
                for i, (a, e) in enumerate(zip(cuts.tolist(), ends.tolist(), strict=True)):
                    if first[a]:
                        if held:
                            done.append(finished(held))
                        held = {"conv": convs[i], "marks": [], "low": None, "high": None, "illegal": 0, "fresh": 0}
                    held["marks"].append(marks[a:e])
                    held["illegal"] += int(illegal[i])
                    held["fresh"] += int(fresh[i])
                    if some[i]:
                        held["low"] = int(low[i]) if held["low"] is None else min(held["low"], int(low[i]))
                        held["high"] = int(high[i]) if held["high"] is None else max(held["high"], int(high[i]))
                if done:
                    yield out(done)
            if held:
                yield out([finished(held)])

    shape = f"conv {rows.schema[conv].dataType.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
    return fed.mapInArrow(run, shape)


_MUST_GO = bytes.maketrans(b"bd", (MUST_GO * 2).encode())


def plans(signed: DataFrame) -> DataFrame:
    """signed (of signatures(), signature reversed for the order) with cost and audit in the place of the signature.

    A signature that very many conversations have is dealt to several ranges by their ids.
    """
    signed = signed.withColumn("signature", F.reverse("signature"))
    ranged = signed.repartitionByRange("signature", F.xxhash64("conv")).sortWithinPartitions("signature")
    names = [c for c in signed.columns if c != "signature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with counted_memory():
            suffixes, before, result = Suffixes(), None, (0, "")
            for b in batches:
                found = []
                for s in b.column("signature").to_pylist():
                    if s != before:
                        before, result = s, suffixes.best(s)
                    found.append(result)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(n) for n in names), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=[*names, "cost", "audit"]
                )

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in signed.schema.fields if f.name != "signature")
    return ranged.mapInArrow(run, f"{shape}, cost long, audit string")


class _Editor:
    """Applies one conversation's audit to its rows, in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.place = audit, 0, 0, 0

    def _emit(self, role: str | None, text: str) -> tuple[int, str, str]:
        role = NEXT_ROLE[self.state] if role is None else role
        self.state = STEPS[self.state, role[0]]
        self.place += 1
        return self.place, role, text

    def inserts(self) -> Iterator[tuple[int, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._emit(None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._emit(role if edit == "K" else None, text)


def _edited(rows: DataFrame, planned: DataFrame, columns: tuple[str, str, str, str]) -> DataFrame:
    """The conversations' plans and rows in one stream: a plan (real is false) before its conversation's rows in order."""
    own = _rows(rows, *columns).withColumn("h", _print(F.col("role"), F.col("text"))).withColumn("real", F.lit(True))
    both = own.unionByName(planned.withColumn("real", F.lit(False)), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "real", F.col("turn").asc_nulls_first(), "h")


def repaired_rows(rows: DataFrame, planned: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, place (from 1), role, text: the rows of each conversation after the edits of its audit (of repair())."""
    stream = _edited(rows, planned.select(F.col(conv).alias("conv"), "audit"), (conv, turn, role, text)).select("conv", "real", "audit", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, own, kind = None, None, None
        with counted_memory():
            for b in batches:
                made, kind = [], b.schema.field(0).type
                for c, real, audit, r, t in zip(*(col.to_pylist() for col in b.columns), strict=True):
                    if real:
                        made += [(own, *e) for e in editor.row(r, t)]
                    else:
                        made += [(own, *e) for e in editor.inserts()] if editor else []
                        editor, own = _Editor(audit), c
                yield _batch(made, kind)
            if editor:
                yield _batch([(own, *e) for e in editor.inserts()], kind)

    def _batch(made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, (kind, pa.int64(), pa.string(), pa.string()), strict=True)], names=[conv, "place", role, text])

    return stream.mapInArrow(run, f"`{conv}` {rows.schema[conv].dataType.simpleString()}, place long, `{role}` string, `{text}` string")


def repair(rows: DataFrame, every: DataFrame | None = None, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    Rows are taken in order of turn, nulls first; rows of one turn in order of a 128-bit hash of role and text, equal ones
    side by side. Null roles and texts are one space, a null conversation id is an id. A row's first fault counts: blank,
    the same role and text as an earlier row, cut off. repaired_sha256 is of the repaired role:text lines. Conversations
    of `every` without a row have zeros, an empty audit and the hash of nothing; an empty table gives no rows. Only the
    columns named are read. A conversation of very many rows is streamed by one task, since the hash is of its rows in
    order.
    """
    limit_batches(rows.sparkSession)
    planned = shared(plans(shared(signatures(rows, every, conv=conv, turn=turn, role=role, text=text))))
    stream = _edited(rows, planned, (conv, turn, role, text))
    kept = [f for f in planned.schema.fields if f.name != "conv"]
    names = [conv, *(f.name for f in kept), "repaired_sha256"]
    fed = stream.select("real", "role", "text", "conv", *(f.name for f in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, plan, digest = None, None, None

        def add(edits: Iterator[tuple[int, str, str]]) -> None:
            for place, r, t in edits:
                digest.update(f"\n{r}:{t}".encode() if place > 1 else f"{r}:{t}".encode())

        def close(done: list[tuple[pa.RecordBatch, str]]) -> None:
            if editor:
                add(editor.inserts())
                done.append((plan, digest.hexdigest()))

        with counted_memory():
            for b in batches:
                done: list[tuple[pa.RecordBatch, str]] = []
                real, roles, texts = (b.column(i).to_pylist() for i in range(3))
                audits = b.column(b.num_columns - 1)
                for i in range(b.num_rows):
                    if real[i]:
                        add(editor.row(roles[i], texts[i]))
                    else:
                        close(done)
                        editor, digest = _Editor(audits[i].as_py()), hashlib.sha256()
                        plan = [c[i] for c in b.columns[3:]]
                yield _closed(done, b.schema)
            done = []
            close(done)
            if done:
                yield _closed(done, b.schema)

    def _closed(done: list[tuple[list[pa.Scalar], str]], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([p[i].as_py() for p, _ in done], type=schema.field(3 + i).type) for i in range(len(kept) + 1)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in done], pa.string())], names=names)

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return fed.mapInArrow(run, f"`{conv}` {rows.schema[conv].dataType.simpleString()}, {shape}, repaired_sha256 string")

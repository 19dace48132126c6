"""Conversation repair against a search over all edits, and the whole query against plain Python and its SQL."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import queries, repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, repaired rows) by Dijkstra over what has been read and the roles written; rows: (role, text, fault)."""
    queue, seen = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, out = heapq.heappop(queue)
        if i == len(rows) and GRAMMAR.fullmatch("".join(r[0][:1] for r in out)):
            return cost, audit, out
        if (i, last, cost, audit) in seen:
            continue
        seen.add((i, last, cost, audit))
        options = [(5, "I", role, "", 0) for role in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            options.append((2, "D", None, None, 1))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                options.append((more, "K", role, text, 1))
                options += [(more + 1, "R", r, text, 1) for r in ("user", "assistant")]
        for more, edit, role, text, step in options:
            now = out if role is None else (*out, (role, text))
            written = "".join(r[0][:1] or "?" for r in now)
            if re.fullmatch(r"s?(ua)*u?", written):
                heapq.heappush(queue, (cost + more, audit + edit, i + step, written[-1:] if written else "", now))


def fault_of(rows, i):
    role, text = rows[i]
    bare = text.strip(" \t\n\v\f\r")
    if not bare:
        return "blank"
    if (role, text) in rows[:i]:
        return "duplicate"
    return None if bare[-1] in ".!?" else "truncated"


def expected(rows):
    """rows: (turn, role, text) in order, of one conversation."""
    own = [(r, t) for _, r, t in rows]
    faults = [fault_of(own, i) for i in range(len(own))]
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(own, own[1:]))
    cost, audit, out = cheapest([(r, t, f) for (r, t), f in zip(own, faults, strict=True)])
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest())


def conversation(rng, n):
    roles = ["user", "assistant", "system", "tool", "user", "assistant", "", "understudy", "Assistant"]
    texts = ["Hello.", "Hello.", "cut off", "", " \t\n", "Why? ", "Yes!\n", "é", "no end 。"]
    return [(rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}.") for _ in range(n)]


def test_repair_against_a_search_over_all_edits(spark):
    rng = random.Random(11)
    every = {i: conversation(rng, rng.randint(1, 9)) for i in range(250)}
    every |= {1000 + i: [(0, "user", f"Q{i}?"), (1, "assistant", f"A{i}.")] for i in range(300)}  # one very common signature
    every[None] = [(None, " ", " "), (1, "user", "x.")]
    rows = [(i, *r) for i, c in every.items() for r in c]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("audit", F.lit("clash")).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair.repair(table).collect()}
    assert got.keys() == every.keys()
    for i, c in every.items():
        assert got[i] == expected(sorted(c, key=order)), (i, sorted(c, key=order))
    fixed = repair.repaired_rows(table, repair.repair(table)).orderBy("conv_id", "place").collect()
    for i in every:
        mine = [r for r in fixed if r.conv_id == i]
        assert [r.place for r in mine] == list(range(1, len(mine) + 1))
        assert GRAMMAR.fullmatch("".join(r.role[:1] for r in mine))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == got[i][-1]


def test_a_path_of_nodes_is_shared():
    rng, made = random.Random(3), repair.Suffixes()
    calls = []
    before = made.automaton.before
    made.automaton.before = lambda letter, after: calls.append(letter) or before(letter, after)
    signatures = sorted({"".join(rng.choice("suaxSUAX-") for _ in range(rng.randint(0, 6))) for _ in range(400)})
    found = {s: made.best(s) for s in signatures}
    assert len(calls) == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})  # each node once
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "-": "user"}
    for s in signatures:
        rows = [(role[c.lower()], f"t{k}", "blank" if c == "-" else "truncated" if c.isupper() else None) for k, c in enumerate(reversed(s))]
        assert found[s] == cheapest(rows)[:2], s
    assert made.best("au" * 50_000)[0] == 0 and len(made.automaton.made) < 3000


def test_a_long_conversation_and_empty_ones(spark):
    rows = [(7, k, "assistant" if k % 2 else "user", f"Row {k}.") for k in range(5000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = repair.repair(table).first()
    assert (got.cost, got.audit, got.gaps) == (0, "K" * 5000, 0)
    lone = repair.repair(table.where("turn < 0"), every=table).first()
    assert tuple(lone) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair(table.where("turn < 0")).count() == 0


def test_query_against_python_and_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(8)
    rows = [(i if i else None, *r) for i in range(60) for r in conversation(rng, rng.randint(1, 8))]
    rows += [(99, None, None, None), (99, None, None, "Said."), (98, 3, "user", None), (rows[5]), (rows[5])]
    rows += [r for r in rows[:120:3] for _ in range(3)]  # rows equal in all, some at a conversation's start
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, queries.op11_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    damaged, spaced = {r[0]: [] for r in rows}, lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        part = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        damaged[conv] += [(turn, "user" if part == 4 else role, text)] * {0: 0, 3: 2}.get(part, 1)
    assert got == sorted(((i, *expected(sorted(c, key=order))) for i, c in damaged.items()), key=str)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.execute(queries.OP11_SQL).fetchall(), key=str) == got

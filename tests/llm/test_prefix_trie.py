"""The trie of conversation prefixes against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long, owner long, __range int, `a.b` int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 140), 200, 205, 399, 1000, 1001, -7, 2**40 + 1]:
        n = 60 if c == 3 else rng.randrange(0, 7)
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é\U0001f600", "", None, "long " * 300])) for t in range(n)]
    rows += [(c, t, "user", "same") for c in range(500, 600) for t in range(4)]  # a crowded end
    rows += [(5, None, "system", "null turn"), (5, None, "system", "another null turn"), (6, 0, "user", "a"), (6, 0, "user", "a"), (None, 0, "user", "no id"), (777, 1, "user", "one")]
    return [(*r, "clash", 9, 9, 1, 2) for r in rows]


def plain(rows, block=100, most=6):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % most
        base = c - (c - block * int(c / block))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(out[k][5] for k in kids[node]) or 1
        saved = sum(out[k][6] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[node] = (min(members[node]), len(node), parent, len(members[node]), len(kids[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return set(out.values())


@pytest.mark.parametrize("heavy", [10_000, 3])
def test_trie_is_the_plain_one(spark, monkeypatch, heavy):
    from tessera.llm import prefixes

    monkeypatch.setattr(prefixes, "HEAVY", heavy)
    monkeypatch.setattr(prefixes, "SHARE", 10**9 if heavy < 100 else 1000)  # 3: nearly every key is broadcast
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = [tuple(r) for r in prefixes.prefix_trie(df).select(COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_one_conversation_and_none(spark):
    from tessera.llm import prefixes

    rows = [(7, 1, "user", "x", None, 0, 0, 0, 0), (7, 2, "assistant", "y", None, 0, 0, 0, 0)]
    got = {tuple(r) for r in prefixes.prefix_trie(spark.createDataFrame(rows, SCHEMA)).select(COLUMNS).collect()}
    assert got == plain(rows)
    assert prefixes.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", None, 0, 0, 0, 0)], SCHEMA)).collect() == []


def test_sums_of_a_group_over_many_ranges(spark):
    from pyspark.sql import functions as F

    from tessera.operators.numbering import running_in_groups

    df = spark.range(5000).select((F.col("id") % 50 == 0).cast("bigint").alias("g"), F.col("id").alias("at"), (F.col("id") % 7).alias("w"))
    rows = running_in_groups(df, "g", [F.col("at").desc()], {"s": F.col("w")}).collect()
    want = {}
    for g in (0, 1):
        total = 0
        for i in sorted((i for i in range(5000) if (i % 50 == 0) == bool(g)), reverse=True):
            total += i % 7
            want[g, i] = total
    assert {(r.g, r["at"]): r.s for r in rows} == want

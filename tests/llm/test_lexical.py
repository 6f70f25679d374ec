"""Ranked search against scores counted one by one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import SCHEMA, documents, empty, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, doc_id long, term string, weight int, `a.b` int"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=20):
    docs = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n, size = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = defaultdict(Counter)
    for i, text in items:
        asked[i] += Counter(terms(text))
    out = []
    for item, query in asked.items():
        scored = []
        for i, c, m in docs:
            norm = 75 + 25 * m * n // size
            s = sum(times * math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * norm)) for t, times in query.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def item_rows(texts):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample((t or "x").split() or ["x"], min(8, len((t or "x").split() or ["x"]))))) for i, t in enumerate(texts) if i % 3 == 0]
    return [*rows, (1, "ka LO mi lo"), (1, "ter An"), (7000, None), (7001, ""), (7002, "??"), (7003, "nowhere-at-all zzzz"), (None, "ka ka Ünïcödé"), (7004, prose(rng, 2000))]


@pytest.mark.parametrize(("shard", "sent"), [(16 << 20, 64 << 20), (3000, 400)])
def test_search_is_exact(spark, monkeypatch, shard, sent):
    from tessera.llm import lexical

    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "SENT_BYTES", sent)
    monkeypatch.setattr(lexical, "FIRST", 3)
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = item_rows([t for _, t in rows])
    table = spark.createDataFrame([(i, t, 1, "clash", 2, 3) for i, t in items], ITEMS).repartition(2)
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.rank_documents(docs, table).collect()), key=repr)
    assert got == plain(rows, items)


def test_empty_tables(spark):
    from tessera.llm import lexical

    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "ka lo", 1, "", 1, 1)], ITEMS)
    assert lexical.rank_documents(empty(spark), some).collect() == []
    assert lexical.rank_documents(documents(spark), none).collect() == []
    wordless = spark.createDataFrame([(1, None), (2, "?!")], "doc_id long, text string")
    assert lexical.rank_documents(wordless, some).collect() == []
    assert "doc_id long" in SCHEMA


def test_bytes_of_postings_read_back():
    from tessera.llm.lexical import packed, unpacked

    values = np.array([0, 1, 127, 128, 300, 2**14 - 1, 2**14, 2**40, 5, 2**62], np.int64)
    data, at = packed(values)
    assert unpacked(data).tolist() == values.tolist() and at[-1] == len(data)
    assert unpacked(packed(values[:0])[0]).tolist() == []
    assert [unpacked(data[a:b]).tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[v] for v in values.tolist()]


def test_blocks_below_the_threshold_stay_packed():
    """A rare term decides; blocks of a frequent one that lie away from it are passed over."""
    from tessera.llm import lexical

    n = 6000
    texts = ["the " * (1 + i % 3) + f"w{i}" + (" rare" * 5 if i in (2500, 2501, 2503) else "") for i in range(n)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    building = lexical._Building()
    building.add(list(range(n)), data, at)
    size = sum(len(terms(t)) for t in texts)
    row = building.row("0", n, size).to_pylist()[0]
    shard = lexical.Shard(row, n, size)
    assert shard.counts.sum() == 2 * n + 3 and len(shard.open) >= n // 128
    hashes = {w: lexical._terms(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0] for w in ("the", "rare")}
    found, scores = shard.search(np.array(list(hashes.values())), np.array([1, 9000]), 3)
    assert sorted(found.tolist()) == [2500, 2501, 2503] and (np.diff(scores) <= 0).all()
    first = shard.open.sum()
    again = lexical.Shard(row, n, size)
    again.search(np.array(list(hashes.values())), np.array([1, 9000]), 3, int(scores[-1]))
    assert again.open.sum() <= 3 < first + 1  # one block of the rare term's, one or two of the frequent one's
    assert len(again.search(np.array(list(hashes.values())), np.array([1, 9000]), 3, int(scores[0]) + 1)[0]) == 0


@pytest.mark.parametrize(("block", "window"), [(128, 2048), (4, 3), (1, 1), (7, 50)])
def test_a_shard_is_exact_for_any_block_and_window(monkeypatch, block, window):
    from tessera.llm import lexical

    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "WINDOW", window)
    rng = random.Random(block)
    texts = [prose(rng, rng.randrange(0, 30)) for _ in range(300)]
    joined = [t.encode() for t in texts]
    building = lexical._Building()
    building.add([7 * i % 300 for i in range(300)], np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in joined])]))
    n, size = sum(1 for t in texts if t), sum(len(terms(t)) for t in texts)
    shard = lexical.Shard(building.row("0", n, size).to_pylist()[0], n, size)
    for _ in range(20):
        asked = Counter(rng.choice(["ka", "lo", "mi", "kalo", "ter", "anun", "none"]) for _ in range(5))
        raw = "".join(asked).encode()
        hashes = lexical._terms(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in asked])]))[0]
        want = []
        for i, t in enumerate(texts):
            c = Counter(terms(t))
            s = sum(times * (10**9 * c[w] // (1000 * c[w] + 12 * (75 + 25 * sum(c.values()) * n // size))) for w, times in asked.items() if c[w])
            if s:
                want.append((-s, 7 * i % 300))
        found, scores = shard.search(hashes, np.array(list(asked.values())), 6)
        assert [(-int(s), int(shard.order[f])) for f, s in zip(found, scores, strict=True)] == sorted(want)[:6]

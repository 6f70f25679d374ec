"""The external sorter at its registered settings, and how much of the repeats it finds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import induced, suffixes


def test_queues_go_to_disk_at_registered_settings():
    rng = np.random.default_rng(6)
    words = [rng.integers(98, 123, int(rng.integers(2, 10))).astype(np.uint8) for _ in range(5000)]
    parts = [np.append(words[i], np.uint8(33)) for i in rng.integers(0, 5000, 620_000)]
    text = np.append(np.concatenate(parts), np.uint8(0))
    text[2_000_000:2_000_400] = text[1_000_000:1_000_400]
    assert len(text) > 4_000_000
    with induced.InducedSorter(suffixes.MEMORY) as sorter:
        got = list(sorter.descending(text, 100))
        assert sorter.spills > 0
    pos, common = (np.concatenate(x) for x in zip(*got, strict=True))
    assert np.array_equal(np.sort(pos), np.arange(len(text) - 1))
    data = text.tobytes()
    for i in rng.integers(1, len(pos), 2000).tolist():
        larger, smaller = (data[p : p + 400] for p in (pos[i - 1], pos[i]))
        assert larger >= smaller
        assert common[i] == induced._common(text, int(pos[i - 1]), int(pos[i]), 100)


def test_reduced_strings_recurse_from_files():
    rng = np.random.default_rng(7)
    text = np.concatenate([rng.integers(1, 5, 20_000), [0]]).astype(np.uint8)
    with induced.InducedSorter(memory=500, base=300) as sorter:
        got = np.concatenate([p for p, _ in sorter.descending(text, 0)])[::-1]
        assert sorter.recursions >= 1 and sorter.spills > 0
    rank = np.empty(len(text), np.int64)
    rank[induced._doubling(text)] = np.arange(len(text))
    assert np.array_equal(np.argsort(rank)[1:], got)


def test_most_repeated_windows_come_from_the_sorter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"), "text")
    windows = lambda spans: spans.select(F.explode(F.arrays_zip("starts", "ends")).alias("s")).agg(F.sum(F.col("s.ends") - F.col("s.starts") - 99)).first()[0] or 0
    settled = windows(suffixes.find_stretches(rows, 16, 100))
    assert windows(suffixes.repeated_spans(rows)) - settled > settled


def test_a_shallow_sorter_orders_by_the_cap():
    rng = np.random.default_rng(8)
    words = [rng.integers(2, 6, int(rng.integers(1, 6))).astype(np.uint8) for _ in range(40)]
    part = np.concatenate([words[i] for i in rng.integers(0, 40, 3000)])
    text = np.concatenate([part, [9], part[:2500], part[:2500], [8], part, np.full(700, 3), [0]]).astype(np.uint8)
    data = text.tobytes()
    for cap in (1, 7, 20, 100):
        with induced.InducedSorter(memory=700, shallow=True) as sorter:
            pos, common = (np.concatenate(x) for x in zip(*sorter.descending(text, cap), strict=True))
        assert np.array_equal(np.sort(pos), np.arange(len(text) - 1))
        heads = [data[p : p + cap] for p in pos.tolist()]
        assert all(a >= b for a, b in zip(heads, heads[1:], strict=False))
        assert [induced._common(text, int(a), int(b), cap) for a, b in zip(pos, pos[1:], strict=False)] == common[1:].tolist()


def test_names_order_substrings_of_any_bytes():
    rng = np.random.default_rng(9)
    for most, n in ((3, 400), (255, 3000), (4, 40), (2, 12), (255, 9), (200, 8), (5, 5)):
        for repeat in (1, 3):
            part = np.sort(rng.integers(1, most + 1, (n, 6)), axis=1)[:, :: -1 if most == 4 else 1].ravel() if most == 4 else rng.integers(1, most + 1, n)
            text = np.append(np.tile(part, repeat), 0).astype(np.uint8)
            with induced.InducedSorter() as sorter:
                got = list(sorter.descending(text, 0))
            order = np.concatenate([p for p, _ in got])[::-1]
            data = text.tobytes()
            assert order.tolist() == sorted(range(len(text) - 1), key=lambda i: data[i:])


def test_a_queue_gives_no_more_than_a_chunk_at_once(tmp_path):
    queue = induced.SuffixQueue(str(tmp_path), 4 * induced.CHUNK)
    part = np.arange(induced.CHUNK - 1000)
    for k in range(3):
        queue.push(5, part + k, np.full(len(part), k, np.uint8))
    got = list(queue.take(5))
    assert max(len(p) for p, _ in got) <= induced.CHUNK
    assert np.array_equal(np.concatenate([p - c for p, c in got]), np.tile(part, 3)) and queue.count == 0


def test_a_shard_with_over_a_chunk_of_one_byte_and_a_rare_one():
    """Spaces fill more than a chunk of their queue; the one tab before a space comes at its beginning."""
    rng = np.random.default_rng(1)
    entries, length = 10_400, 100
    pieces = np.full((entries, 133), 32, np.uint8)
    pieces[:, ::2] = rng.integers(97, 122, (entries, 67))
    pieces[entries // 2 :: 2] = pieces[: entries // 2 : 2]
    pieces[77, 40], pieces[77, 42:72:2] = 9, 122
    text = np.append(np.column_stack([pieces + np.uint8(1), np.full(entries, 255, np.uint8)]).ravel(), np.uint8(0))
    with induced.InducedSorter(suffixes.MEMORY, shallow=True) as sorter:
        entry, offset = suffixes.repeated_windows(text, np.arange(entries) * 134, np.full(entries, 34), np.arange(entries) << 33, length, sorter)
    seen, want = set(), set()
    for i, data in enumerate(pieces):
        for k in range(34):
            window = data[k : k + length].tobytes()
            want |= {(i, k)} if window in seen else set()
            seen.add(window)
    assert len(want) > 50_000 and want == set(zip(entry.tolist(), offset.tolist(), strict=True))


def test_stretches_gathered_over_several_blocks_or_none_give_one_result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [sorted((r.doc_id, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs, fetched=n).collect()) for n in (0, 20_000, suffixes.FETCHED)]
    assert got[0] == got[1] == got[2] and sum(r[1] for r in got[0]) > 10_000

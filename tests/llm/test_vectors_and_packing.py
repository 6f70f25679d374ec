"""Searches against brute force, packing by its rules, and the pipeline."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import AWKWARD, SCHEMA, documents, empty


def vector_table(spark, n=400, dim=16, extra=True):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim))
    x[1::37] = x[0]  # copies
    rows = [(i, [float(np.float32(v)) for v in r], 1, "clash") for i, r in enumerate(x)]
    if extra:
        nan, inf = float("nan"), float("inf")
        rows += [(91000, None, 1, ""), (91100, [], 1, ""), (91200, [nan] * dim, 1, ""), (91300, [inf] * dim, 1, ""), (91400, [None] * dim, 1, ""), (91500, [0.0] * dim, 1, ""), (None, [1.0] * dim, 1, ""), (91600, [1.0, 2.0], 1, ""), (91601, [2.0, 2.0], 1, ""), (200, rows[200][1], 1, "")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string").repartition(4)


def usable(rows, nonzero):
    """(id, vector) of the rows that take part; rows that repeat an id are candidates each."""
    out = []
    for r in rows:
        v = r.embedding
        if r.vec_id is not None and v and all(a is not None and np.isfinite(a) for a in v) and (not nonzero or any(v)):
            out.append((r.vec_id, np.array(v, float)))
    return out


def asked(own, q):
    """The one vector that stands for a query id: the shortest, then the first by components."""
    return min((x for i, x in own if i == q), key=lambda x: (len(x), x.tolist()))


def test_mtree_is_exact(spark):
    from tessera.llm import mtree

    df = vector_table(spark)
    own = [(i, np.floor(1024 * v).astype(np.int64)) for i, v in usable(df.collect(), False)]
    want = set()
    for q in {i for i, _ in own if i % 100 == 0}:
        x = asked(own, q)
        ranked = sorted((-int(x @ y), c) for c, y in own if c != q and len(x) == len(y))
        want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(ranked[:10])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(df).collect()} == want


def test_mtree_on_ties_and_large_numbers():
    from tessera.llm import mtree

    same = mtree.MTree(np.arange(500), np.ones((500, 4)))
    ids, scores = same.nearest(0, np.ones(4), 10)
    assert ids.tolist() == list(range(1, 11)) and set(scores.tolist()) == {4 * 1024**2}
    big = mtree.to_integers(np.array([[1e16, 1.0], [2e16, 3.0]]))
    assert mtree.exact_dot(big, big[0]).tolist() == [sum(int(a) * int(b) for a, b in zip(r, big[0])) for r in big]


def test_searches_on_empty_tables(spark):
    from tessera.llm import hashing, mtree

    none = vector_table(spark, 3, extra=False).where("vec_id < 0")
    assert mtree.top_k(none).count() == 0 and hashing.approximate(none).count() == 0
    one = vector_table(spark, 1, extra=False)
    assert mtree.top_k(one).count() == 0 and hashing.approximate(one).count() == 0


def test_multi_index_recall(spark):
    from tessera.llm import hashing

    df = vector_table(spark, 2000)
    own = usable(df.collect(), True)
    hits = total = 0
    got = defaultdict(list)
    for r in hashing.approximate(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    for q in {i for i, _ in own if i % 50 == 0}:
        score = [(float((x * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x**2).sum()))), c) for i, x in own for c, v in own if i == q and c != q and len(v) == len(x)]
        best = sorted(score, key=lambda s: (-s[0], s[1]))[:5]
        of = {c: s for s, c in score}
        assert [r["rank"] for r in got[q]] == list(range(1, len(best) + 1))
        assert all(abs(r.score - of[r.vec_id]) < 1e-12 for r in got[q])
        assert [(-r.score, r.vec_id) for r in got[q]] == sorted((-r.score, r.vec_id) for r in got[q])
        hits += len({r.vec_id for r in got[q]} & {c for _, c in best})
        total += len({c for _, c in best})
    assert hits >= 0.9 * total and 91000 not in got and 91500 not in got


@pytest.mark.parametrize("shard_pieces", [20_000, 7])
def test_packing(spark, shard_pieces, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm import packing

    monkeypatch.setattr(packing, "SHARD_PIECES", shard_pieces)
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = documents(spark)
    model = Tokenizer.from_file(path)
    capacity = 512
    want = []
    for r in docs.collect():
        ids = np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, n, lo, len(ids[lo : lo + capacity]), zlib.crc32(ids[lo : lo + capacity].tobytes())) for n, lo in enumerate(range(0, len(ids), capacity))]
    out = packing.pack_documents(docs, path, capacity).collect()
    assert sorted(map(str, ((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out))) == sorted(map(str, want))
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= capacity
    assert len(bins) <= -(-sum(w[3] for w in want) // capacity) + 1
    assert packing.pack_documents(empty(spark), path).count() == 0


def test_plain_words_are_tokenized_as_the_library_does():
    import public_tokenizers

    from tessera.llm import packing

    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(0)
    chars = [chr(c) for c in range(0x250)]
    texts = ["".join(rng.choice(chars, 40)) for _ in range(300)] + ["It's 10 O'CLOCK, ''s don't <|endoftext|> x", "Ça ²³ µ ª ß", ""]
    texts += ["".join(rng.choice(list("aB 'sdt019-_!\n\té"), 40)) for _ in range(300)]
    assert [a.tolist() for a in ids.encode(texts)] == [e.ids for e in ids.model.encode_batch(texts, add_special_tokens=False)]


def test_genetic_packing_beats_or_equals_best_fit():
    from tessera.llm import packing

    rng = np.random.default_rng(2)
    length = rng.choice([1366, 1365, 1000, 2047, 700, 33], 600)
    bins, room = [], []
    packing.best_fit(length, np.argsort(-length, kind="stable"), bins, room, 4096)
    best = packing.evolve(length, 4096, 1)
    assert len(best.bins) <= len(bins) and sorted(i for b in best.bins for i in b) == list(range(600))
    assert all(length[b].sum() + r == 4096 for b, r in zip(best.bins, best.room, strict=True))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tessera.llm import quality, suffixes
    from tests.llm.test_similar import brute_kept, stayed

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 90, 3)] + [(7, 0, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now = read
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert i == 4 or out.columns == read.columns
        assert i == 4 or {tuple(r) for r in out.select("`a.b`", "__id", "__cut", "__taken", "row", "id", "rest", "words").collect()} == {AWKWARD}
        out.write.parquet(f"{tmp_path}/stage{i}")
        before, now = now, spark.read.parquet(f"{tmp_path}/stage{i}")
        if i == 1:
            assert stayed(now) == brute_kept([(r.doc_id, r.text) for r in before.collect()])
        if i == 2:
            left = sorted((str(r.doc_id), r.n_bytes - r.n_removed) for r in suffixes.remove_repeats(before).collect())
            assert all(i == j and kept <= n for (i, kept), (j, n) in zip(left, sorted((str(r.doc_id), len((r.text or "").encode())) for r in now.collect()), strict=True))
    good = {r.doc_id for r in quality.score_documents(read, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in spark.read.parquet(f"{tmp_path}/stage0").collect()} == good
    key = lambda r: (str(r.doc_id), r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(key, now.collect()))


def test_stages_of_an_empty_table_and_of_long_texts(spark, tmp_path):
    import corpus_pipeline

    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty(spark), str(tmp_path))
        assert out.count() == 0 and (stage is corpus_pipeline.STAGES[-1][1] or out.columns == empty(spark).columns)
    long = "word after word " * 40_000
    rows = [(1, long, "en", "s", 9, 7, "k", 9, 11, *AWKWARD), (2, "another text altogether", None, None, 1, 7, None, 9, 11, *AWKWARD)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:4]):
        kept = stage(spark, docs, str(tmp_path)).collect()
        assert {r.doc_id for r in kept} <= {1, 2} and kept
        assert k or len(kept) == 2


def test_two_runs_over_one_folder_at_a_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    import corpus_pipeline

    documents(spark).limit(12).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read, together = spark.read.parquet(f"{tmp_path}/documents.parquet"), Barrier(2)

    def run(name):
        now = read
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
            together.wait(300)
            out = stage(spark, now, str(tmp_path))
            together.wait(300)  # both have made their tables before either writes its result
            out.write.parquet(f"{tmp_path}/{name}{i}")
            now = spark.read.parquet(f"{tmp_path}/{name}{i}")
        return sorted(str(r.doc_id) for r in now.collect())

    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(run, "ab")
    assert one == two and one


def test_queries_have_all_fourteen():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_rows_that_repeat_an_id_are_candidates_each(spark):
    from tessera.llm import hashing, mtree

    rows = [(0, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [5.0, 0.0]), (7, [5.0, 0.0]), (0, [0.0, 2.0]), (3, [1.0, 2.0]), (5, [-1.0, 9.0]), (5, [-1.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    first = (0.0, 2.0)  # of the two rows of id 0
    pairs = sorted((-sum(int(1024 * a) * int(1024 * b) for a, b in zip(first, y, strict=True)), c) for c, y in rows if c != 0)
    got = [(r["rank"], r.vec_id, r.score) for r in mtree.top_k(df).orderBy("rank").collect()]
    assert got == [(n + 1, c, -s) for n, (s, c) in enumerate(pairs[:10])] and len(got) == 6
    cos = lambda x, y: float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    near = sorted((-round(cos(first, y), 9), c) for c, y in rows if c != 0)
    got = [(-round(r.score, 9), r.vec_id) for r in hashing.approximate(df).orderBy("rank").collect()]
    assert got == near[:5]


def test_a_repeated_query_takes_no_candidate_twice(spark):
    from tessera.llm import hashing, mtree

    rows = [(r.vec_id, list(r.embedding)) for r in vector_table(spark, 300, extra=False).collect()]
    more = [(100, rows[100][1]), (100, rows[7][1]), (200, [1.0, 2.0]), (200, rows[200][1]), (17, [3.0, 1.0]), (18, [-1.0, 1.0])]
    df = spark.createDataFrame(rows + more, "vec_id long, embedding array<float>").repartition(3)
    own = [(i, np.array(v, float)) for i, v in rows + more]
    exact = [(r.query_id, r.vec_id, r.score) for r in mtree.top_k(df).collect()]
    assert len(exact) == len(set(exact))
    for q, k in ((100, 10), (200, 2)):
        x = np.floor(1024 * asked(own, q)).astype(np.int64)
        want = sorted((-int(x @ np.floor(1024 * y).astype(np.int64)), c) for c, y in own if c != q and len(y) == len(x))[:k]
        assert sorted((-s, c) for i, c, s in exact if i == q) == want
    near = [(r.query_id, r.vec_id) for r in hashing.approximate(df).collect()]
    assert len(near) == len(set(near)) and {c for q, c in near if q == 200} == {17, 18}


def test_thresholds_miss_no_code_within_the_radius():
    from tessera.llm import hashing

    rng = np.random.default_rng(8)
    rows = rng.normal(size=(3000, 24))
    index = hashing.MultiIndex(np.arange(3000), rows, hashing.Codes(rows[:500], 5))
    away = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :40]).sum(2)
    for radius in (3, 15, 40, 77, 100, 160):
        for q in range(40):
            assert np.array_equal(index.within(index.codes[q], radius), np.flatnonzero(away[:, q] <= radius))


def test_mtree_orders_scores_beyond_a_long():
    from tessera.llm import mtree

    big = mtree.MTree(np.arange(1, 4), np.array([[1e16, 1.0], [4e16, 3.0], [2e16, 3.0]]))
    ids, scores = big.nearest(0, np.array([1e16, 1.0]), 2)
    assert ids.tolist() == [2, 3] and scores.tolist() == [mtree._LONG] * 2


def test_floors_of_the_first_shard_lose_nothing(spark, monkeypatch):
    from tessera.llm import mtree, vectors

    monkeypatch.setattr(vectors, "SHARD_ROWS", 40)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 3)
    test_mtree_is_exact(spark)
    rng = np.random.default_rng(3)
    rows = rng.integers(-40, 40, (900, 6)).astype(float) / 8
    tree = mtree.MTree(np.arange(900), rows)
    for q in range(0, 900, 90):
        ids, scores = tree.nearest(q, rows[q], 10)
        for floor in (int(scores[-1]), int(scores[3])):
            kept = [(i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True) if s >= floor]
            again = list(zip(*[x.tolist() for x in tree.nearest(q, rows[q], 10, floor)], strict=True))
            assert again[: len(kept)] == kept

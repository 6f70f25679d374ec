"""Near copies of the pipeline's stage against brute force over all pairs of five-word shingle sets."""

from __future__ import annotations

import random

import pytest

from tests.llm.fixtures import documents, empty, prose

SCHEMA = "doc_id long, text string, lang string"


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_kept(rows, k=5):
    """The ids that stay, one a component of pairs with similarity of at least 0.8."""
    sets, parent = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), (True, 0)), (d is None, d or 0))
    return sorted(map(str, least.values()))


def edited(rng, text, changes):
    words = text.split()
    for at in rng.sample(range(len(words)), min(changes, len(words))):
        words[at] = "changed" + str(rng.randrange(10**6))
    return " ".join(words)


def copies():
    rng = random.Random(4)
    out = []
    for words in (6, 20, 60, 100, 400):
        for _ in range(4):
            text = prose(rng, words)
            out += [text, *[edited(rng, text, n) for n in range(1, 8)], text + " " + prose(rng, words // 10), " ".join(text.split()[: words * 9 // 10])]
    line = prose(rng, 12)
    out += [line + " " + prose(rng, rng.randrange(1, 30)) for _ in range(60)]  # a line in many texts
    group = prose(rng, 80)
    out += [edited(rng, group, rng.randrange(4)) for _ in range(60)]  # one large group
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate([None, "", " \n", "One two", "one  TWO", *out])]


def test_parities_never_exclude_a_link():
    import numpy as np
    import pyarrow as pa

    from tessera.llm import similar

    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 120, 127, 128, 130, 255, 256, 700):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 62, max(1, n // 20)).astype(np.uint64)]))
            differ = len(np.setxor1d(a, b))
            assert similar.least_difference(similar.parity(a), similar.parity(b)) <= differ
            size = np.array([len(a), len(b)])
            marks = [similar.signature(x, similar.LIMIT) for x in (a, b)]
            signs = [m[: 40 + n] for m, n in zip(marks, similar._numbers(pa.array(marks))[:, 2].tolist(), strict=True)]
            bits = np.stack([np.frombuffer(similar._folded(m), np.uint64) for m in signs])
            found = [p for i, j in similar.crossed_pairs(np.zeros(2, int), size, np.zeros(2, int), np.arange(2), bits) for p in zip(i.tolist(), j.tolist(), strict=True)]
            both = len(np.intersect1d(a, b))
            assert (0, 1) in found or 5 * both < 4 * (len(a) + len(b) - both)


def stayed(df):
    return sorted(str((r.doc_id is None, r.doc_id or 0)) for r in df.collect())


@pytest.mark.parametrize("sample", [20_000, 40])
def test_changed_words_against_brute_force(spark, sample):
    from tessera.llm import similar

    rows = copies()
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA).repartition(5)
    kept = similar.one_of_similar(docs, sample=sample)
    assert kept.columns == docs.columns and stayed(kept) == brute_kept(rows)


def test_awkward_texts_and_stage(spark):
    import corpus_pipeline

    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert stayed(corpus_pipeline.near_dedup(spark, docs, "")) == brute_kept(rows)
    assert corpus_pipeline.near_dedup(spark, empty(spark), "").count() == 0


def test_one_changed_word_of_a_hundred_goes(spark):
    import corpus_pipeline

    rng = random.Random(8)
    text = [prose(rng, 100) for _ in range(20)]
    rows = [(i, t, "en") for i, t in enumerate(text + [edited(rng, t, 1) for t in text])]
    assert stayed(corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")) == [str((False, i)) for i in sorted(range(20), key=lambda i: str((False, i)))]

"""Text operators against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, empty

WORD = re.compile("[^\x20\x09-\x0d]+")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# chat formatting


def test_chat_reads_back(spark):
    from tessera.llm import chat

    rows = [(1, 0, "user", "hi <|end|> \\ <\\|"), (1, 1, "assistant", "a\\### b <|turn|>x<|text|>"), (1, 2, "assistant", None), (2, 0, None, ""), (None, 5, "assistant", "z<"), (1, 1, "assistant", "again"), (1, 1, "assistant", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fragment", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digest(chat.format_turns(df)).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t, role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_parts(spark):
    from tessera.llm import chat

    parts = [{"type": "text", "text": "see <|"}, {"type": "image", "ref": "i.png", "width": 28, "height": 29}, {"type": "audio", "ref": "a.wav", "seconds": 1.5}, {"type": "document", "ref": "d.pdf", "pages": 2}, {"type": "odd", "ref": "o"}, {"type": "text", "text": "end"}]
    out = chat.format_turn("assistant", None, parts)
    assert [(a["kind"], a["tokens"], a["part"]) for a in out["attachments"]] == [("image", 6, 1), ("audio", 38, 2), ("document", 1024, 3), ("odd", 1, 4)]
    for n, a in enumerate(out["attachments"]):
        assert out["fragment"][a["start"] :].startswith(f"<|{a['kind']}:{n}|>")
    assert [chat.unescape(out["fragment"][s["start"] : s["start"] + s["length"]]) for s in out["loss_spans"]] == ["see <|", "end"]
    df = spark.createDataFrame([(1, 0, "user", None, parts)], "conv_id long, turn long, role string, text string, parts " + chat.PARTS)
    assert chat.digest(chat.format_turns(df)).first().attachment_tokens == 1069


def test_chat_empty(spark):
    from tessera.llm import chat

    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_turns(df)).count() == 0


# mixing


def brute_mix(rows, weights=(5, 2, 1), most=3):
    size = Counter()
    for _, source, n in rows:
        size[source] += n
    names = sorted((s for s in size if s is not None), key=lambda s: s) + ([None] if None in size else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while True:
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if w[s] * level > most * size[s]}
        if not over:
            return size, {**target, **{s: w[s] * level for s in free}}
        for s in over:
            target[s] = float(most * size[s])
            left -= most * size[s]
        free -= over


def test_mixing(spark):
    from tessera.llm import mixing

    docs = documents(spark)
    out = mixing.mix_to_weights(docs).collect()
    rows = [(d, s, len(WORD.findall(t or ""))) for d, t, s in ((r.doc_id, r.text, r.source) for r in docs.collect())]
    size, target = brute_mix(rows)
    assert sorted((r.doc_id or -1, r.size) for r in out) == sorted((d or -1, n) for d, _, n in rows)
    taken = Counter()
    for r in out:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(target[s]) for s in size)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_to_weights(docs.repartition(7)).collect()))


def test_mixing_caps_and_empty(spark):
    from tessera.llm import mixing

    df = spark.createDataFrame([(1, "a b", "x"), (2, "w " * 1000, "y"), (3, None, "z")], "doc_id long, text string, source string")
    out = {r.source: r for r in mixing.mix_to_weights(df).collect()}
    assert out["x"].target == 6.0 and out["x"].taken == 6 and out["z"].target == 0.0 and out["y"].taken == 996
    assert mixing.mix_to_weights(empty(spark)).count() == 0


def test_mixed_documents_hold_the_words_taken(spark):
    from tessera.llm import mixing

    docs = documents(spark)
    plan, out = Counter(), Counter()
    for r in mixing.mix_to_weights(docs).collect():
        plan[r.source] += r.taken
    for r in mixing.mixed_documents(docs).collect():
        out[r.source] += len(WORD.findall(r.text))
    assert +out == +plan and mixing.mixed_documents(docs).columns == docs.columns


# language


def test_language(spark):
    from tessera.llm import language

    rows = [(i, ("the cat and the dog with this " if i % 2 else "der hund und die katze mit dem ") * (1 + i % 5), "en" if i % 2 else "de", "s") for i in range(300)]
    rows += [(1000, None, "en", "s"), (1001, "123 !!", "de", "s"), (1002, "", None, "s"), (1003, "a", None, "s"), (1003, "a", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("clash"))
    out = language.identify(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:300])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002)) and got[1003].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert language.identify(empty(spark)).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# quality


def test_quality(spark):
    from tessera.llm import quality

    rows = [(i, ("ordinary words in a line of prose number seven " if i % 3 else "BUY!! NOW!! $$$ ### ") * (2 + i % 7), 1 if i % 3 else 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None), (501, ""), (None, "x"), (4, "repeat")], "doc_id long, text string").withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(1, None, 0), (None, 1, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.score_documents(docs, labels).collect()
    assert len(out) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    got = {r.doc_id: r for r in out if r.doc_id != 4}
    assert all(got[i].predicted == q for i, _, q in rows if i != 4)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i, _, q in rows if q}
    assert quality.score_documents(docs, labels.where("doc_id < 0")).where("score <> 0.5").count() == 0
    assert quality.score_documents(empty(spark), labels).count() == 0


# SimHash


def brute_fingerprint(text):
    words = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_simhash(spark):
    from tessera.llm import simhash

    docs = documents(spark)
    rows = rows_of(docs)
    fp = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    want = sorted((str(d), f"{fp[i]:016x}", str(min((x for x in least[root(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)


def test_fuzzy_keys_meet_within_two_bits():
    from tessera.llm import simhash

    rng = np.random.default_rng(0)
    a = rng.integers(-(2**63), 2**63 - 1, 500)
    b = a.view(np.uint64).copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 3, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    at, keys = simhash.fuzzy_keys(np.concatenate([a, b.view(np.int64)]))
    own = defaultdict(set)
    for i, k in zip(at, keys, strict=True):
        own[i].add(k)
    assert all(own[i] & own[i + 500] for i in range(500))


def test_bucket_links_connect_large_groups():
    from tessera.llm import simhash

    fp = np.array([0, *[1 << i for i in range(40)], *[(1 << 50) | (1 << 51) | (1 << 52) | (1 << i) for i in range(10)]], np.int64)
    a, b = simhash.bucket_links(np.zeros(len(fp), np.int64), fp)
    assert len(a) == len(fp) - 2  # two trees


# suffix-array dedup


def brute_removed(rows, length):
    """By (id, text): removed bytes, spans and digest; equal rows are one document, texts of one id follow their hashes."""
    order = sorted({(-(1 << 63) if d is None else d, t or "") for d, t in rows}, key=lambda r: (r[0], np.uint64(xxhash.xxh64_intdigest(r[1].encode(), 42)).astype(np.int64)))
    seen, out = {}, {}
    for d, t in order:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            else:
                seen[b[i : i + length]] = d
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        out[(d, t)] = (len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"held": 5, "sorted_bytes": 500, "memory": 50}, {"hot": 1}, {"hot": 2, "held": 50}])
@pytest.mark.parametrize("length", [20, 100])
def test_suffix_dedup(spark, limits, length):
    from tessera.llm import suffixes

    docs = documents(spark)
    want = brute_removed(rows_of(docs), length)
    out = suffixes.remove_repeats(docs, length, carry=docs.columns, **limits).collect()
    assert len(out) == docs.count() and sum(r.n_removed for r in out) > 1000
    for r in out:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[(-(1 << 63) if r.doc_id is None else r.doc_id, r.rest.text or "")]
        assert r.n_removed or r.kept_text == r.rest.text
    assert suffixes.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_of_one_id_with_two_texts(spark):
    from tessera.llm import suffixes

    t = "some passage that is long enough to be found again, " * 3
    df = spark.createDataFrame([(1, t), (1, "x" + t)], "doc_id long, text string")
    assert sum(r.n_removed > len(t) - 1 for r in suffixes.remove_repeats(df).collect()) == 1


def test_induced_sorter_with_small_queues():
    from tessera.llm import induced

    rng = np.random.default_rng(4)
    chunk, induced.CHUNK = induced.CHUNK, 7
    try:
        for trial in range(300):
            t = rng.integers(1, int(rng.choice([2, 3, 6, 200])), int(rng.integers(1, 60)))
            t = np.concatenate([t, t[: len(t) // 2], [0]]).astype(np.uint8)
            order = sorted(range(len(t) - 1), key=lambda i: bytes(t[i:]))
            with induced.InducedSorter(memory=10, base=5 if trial % 2 else 1000) as sorter:
                got = list(sorter.descending(t, 20))
            assert np.concatenate([p for p, _ in got])[::-1].tolist() == order
            common = np.concatenate([c for _, c in got])[::-1]
            assert common[:-1].tolist() == [induced._common(t, a, b, 20) for a, b in zip(order, order[1:], strict=False)]
    finally:
        induced.CHUNK = chunk


# language-model scoring


def brute_scores(rows, depth):
    norm = [" ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))).encode() for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    words = [[*b.split(b" "), b"\n"] if b else [b"\n"] for b in norm]
    count = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    total, v = sum(count.values()), len(count)
    nodes = defaultdict(lambda: [0, 0])

    def steps(b):
        s = b"\n" * depth + b + b"\n"
        for k in range(depth, len(s)):
            for level in range(8):
                yield s[k - depth : k], 1 << level | s[k] >> (8 - level), s[k] >> (7 - level) & 1

    for b, h in zip(norm, held, strict=True):
        if not h:
            for context, prefix, bit in steps(b):
                for d in range(depth + 1):
                    nodes[(context[depth - d :], prefix)][bit] += 1
    children = defaultdict(list)
    for c, p in nodes:
        if c:
            children[(c[1:], p)].append((c, p))
    weight = {}

    def weigh(k):
        a, b = nodes[k]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(k[0]) == depth:
            weight[k] = 1.0
            return own
        below = sum(weigh(c) for c in children[k])
        mixed = np.logaddexp(own, below) - math.log(2)
        weight[k] = math.exp(own - math.log(2) - mixed)
        return mixed

    for k in [k for k in nodes if not k[0]]:
        weigh(k)

    def chance(context, prefix, bit, d=0):
        k = (context[depth - d :], prefix)
        if k not in nodes:
            return 0.5
        own = (nodes[k][bit] + 0.5) / (sum(nodes[k]) + 1)
        return own if d == depth else weight[k] * own + (1 - weight[k]) * chance(context, prefix, bit, d + 1)

    out = []
    for (d, _), b, ws, h in zip(rows, norm, words, held, strict=True):
        base = sum(math.log10((count.get(w, 0) + 1) / (total + v + 1)) for w in ws)
        out.append((d, h, len(ws), sum(count.get(w, 0) > 0 for w in ws), total, base, sum(math.log10(chance(*s)) for s in steps(b))))
    return out


@pytest.mark.parametrize("block_bytes", [6 << 20, 2_000])
def test_lm_scores(spark, block_bytes):
    from tessera.llm import contexts

    docs = documents(spark).where("doc_id is null or length(text) < 3000 or text is null")
    rows = rows_of(docs)
    want = sorted(brute_scores(rows, contexts.DEPTH), key=str)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in contexts.score_documents(docs, block_bytes=block_bytes).collect()), key=str)
    assert [g[:5] for g in sorted(got, key=lambda g: (str(g[0]), g[5]))] == [w[:5] for w in sorted(want, key=lambda w: (str(w[0]), w[5]))]
    for g, w in zip(sorted(got, key=lambda g: (str(g[0]), g[5])), sorted(want, key=lambda w: (str(w[0]), w[5])), strict=True):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-5, abs_tol=1e-4)
    assert contexts.score_documents(empty(spark)).count() == 0


def test_lm_without_training_rows(spark):
    from tessera.llm import contexts

    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = contexts.score_documents(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 2) and math.isclose(row.score, 3 * 8 * math.log10(0.5)) and row.base_score == 0.0


def test_log_gamma():
    from tessera.llm import contexts

    x = np.array([0.5, 1.0, 3.5, 100.0, 1e6])
    assert np.allclose(contexts.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_lm_tells_words_apart_that_a_polynomial_hash_does_not(spark):
    from tessera.llm import contexts

    parity = [bin(i).count("1") % 2 for i in range(1024)]
    word, other = ("".join("ab"[b ^ flip] for b in parity) for flip in (0, 1))
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(train[0], word), (train[1], word), (held, other)], "doc_id long, text string")
    rows = {r.doc_id: r for r in contexts.score_documents(docs).collect()}
    assert (rows[held].n_known, rows[train[0]].n_known) == (1, 2)
    assert math.isclose(rows[held].bits_per_byte, -rows[held].score / math.log10(2) / 1025)


def test_words_with_one_first_hash_are_told_apart_by_the_second():
    from tessera.llm import blocks, contexts

    one = np.array([7, 7, 3, 7, 7], np.uint64)
    two = np.array([1, 2, 9, 1, 2], np.uint64)
    a, b, which = contexts.distinct_words(one, two)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(3, 9), (7, 1), (7, 2)] and which.tolist() == [1, 2, 0, 1, 2]
    sums = contexts.WordSums()
    sums.add(one, two, np.ones(5, np.int64))
    sums.settle()
    assert contexts.find_words(sums.held, np.array([7, 7, 7, 4, 9], np.uint64), np.array([2, 1, 5, 1, 1], np.uint64)).tolist() == [2, 2, 0, 0, 0]
    spans = [b"", b"a", b"a\0", b"a\0\0", b"abcdefgh", b"abcdefghi", b"x" * 64, b"x" * 65, b"x" * 700]
    data = np.frombuffer(b"".join(spans), np.uint8)
    end = np.cumsum([len(x) for x in spans])
    start = end - [len(x) for x in spans]
    assert len(set(zip(*[h.tolist() for h in blocks.span_words(data, start, end)], strict=True))) == len(spans)


def test_chat_orders_null_and_empty_roles_alike(spark):
    from tessera.llm import chat

    df = spark.createDataFrame([(1, 0, None, "b"), (1, 0, "", "a"), (1, 0, "", None)], "conv_id long, turn long, role string, text string")
    row = chat.digest(chat.format_turns(df)).first()
    assert row.turns_sha256 == hashlib.sha256(b"\n\n\na\n\nb\n").hexdigest()


def test_crowded_buckets_are_dealt_again(spark, monkeypatch):
    from tessera.llm import simhash

    rng = np.random.default_rng(12)
    base = int(rng.integers(0, 1 << 62))
    family = {base ^ sum(1 << int(b) for b in rng.choice(18, 3, replace=False)) << 46 >> 0 for _ in range(300)}
    fp = np.array(sorted({f & ((1 << 63) - 1) for f in family} | {int(x) for x in rng.integers(0, 1 << 62, 200)}), np.int64)
    want = {tuple(sorted(p)) for p in ((int(a), int(b)) for i, a in enumerate(fp) for b in fp[:i]) if (p[0] ^ p[1]).bit_count() <= 2}

    def groups(links):
        parent = {int(x): int(x) for x in fp}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[root(a)] = root(b)
        out = {}
        for x in parent:
            out.setdefault(root(x), set()).add(x)
        return {frozenset(g) for g in out.values()}

    frame = spark.createDataFrame([(int(x),) for x in fp], "fp long").repartition(3)
    for split in (20_000, 5):
        monkeypatch.setattr(simhash, "SPLIT", split)
        found = {tuple(sorted((r.a, r.b))) for r in simhash.links(frame).collect()}
        assert found <= want and groups(found) == groups(want)

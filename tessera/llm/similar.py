"""Near copies by Jaccard similarity of word shingles: SimHash links first, then an exact join for the rest.

A text is the set of its lower-cased shingles of k words. Two texts are linked
if their sets' Jaccard similarity reaches the limit, and connected components
of the links are groups. Links come in three rounds, each verified:

1. SimHash fingerprints of the sets, linked by Golay-code keys as in `simhash`.
   At similarity 0.8 fingerprints differ in about 10 of 64 bits (standard
   deviation 3), and a radius that misses few such pairs leaves segments too
   short to be keys, so this round finds close copies only, and the other two
   are the exact way for all others.
2. Prefix filtering: with every set in one order of all shingles, two sets of
   that similarity share a shingle among the first n - ceil(limit * n) + 1 of
   each, so no link is missed. The order puts shingles that a sample of texts
   shares last; the sample changes only how many candidates there are. Of a
   shingle's texts, up to BUCKET are all candidates of each other; of more, the
   first HUBS are candidates of all.
3. Texts of crowded shingles that are still in different components are
   candidates of the NEXT ones, in TURNS random orders, which joins most of a
   large group; then all that are left apart are compared in full.

A candidate is verified by parity bitmaps of two bits a shingle, whose
differing bits are never more than the sets' differing shingles, and what
passes on whole sets, each sent once to the other's task; a text with very
many candidates is sent to several tasks, which share these.

Defined cases: null, empty and blank texts have no shingles and equal each
other only; texts of fewer than k words have one shingle; very long texts are
handled whole; shingles are told apart by a 63-bit hash, and equal sets by a
128-bit one; ties and repeated rows leave the row of the smallest place; an
empty table gives an empty result; other columns are carried unchanged,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.blocks import BASE, LOWER, blocks, bounded_batches, distinct_sorted, mix, prefix_hash, raw_bytes, release, slices, span_hash, whole_row, word_spans
from tessera.operators.graph import connected_components
from tessera.session import keep

SHINGLE = 5
#: The limit of similarity, as a fraction.
LIMIT = (4, 5)
BUCKET, HUBS = 4, 3
#: Candidates of a text that one task verifies.
TOGETHER = 500
#: Turns in which crowded shingles link a text to the next ones, and to how many, before those left apart are compared in full.
TURNS, NEXT = 1, 16
#: Bytes of parity that a text takes along where its crowded shingles are compared in full.
FOLDED = 64
#: Texts sampled for shared shingles, the texts of the sample that share one, and the most that are ordered last.
SAMPLE, SHARED, MOST_SHARED = 20_000, 3, 200_000
_LAST = np.uint64(1 << 63)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int = SHINGLE, shared: np.ndarray | None = None) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; those in the sorted array `shared` come last."""
    start, end, owner = word_spans(data, at)
    n = len(at) - 1
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    word = span_hash(prefix_hash(LOWER[data]), start, end)
    left = (first + count)[owner] - np.arange(len(word))
    total = np.minimum(left, k).astype(np.uint64)
    for j in range(min(k, len(word))):
        step = np.uint64(pow(BASE, j + 1, 1 << 64))
        total[: len(word) - j] += np.where(left[: len(word) - j] > j, word[j:] * step, np.uint64(0))
    whole = (left >= k) | (left == count[owner])
    found = mix(total[whole]) >> np.uint64(1)
    if shared is not None and len(shared):
        near = shared[np.minimum(np.searchsorted(shared, found), len(shared) - 1)]
        found = np.where(near == found, found | _LAST, found)
    cut = np.cumsum(np.concatenate([[0], np.bincount(owner[whole], minlength=n)])).tolist()
    return [distinct_sorted(found[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _by_slices(text: pa.Array, k: int, shared: np.ndarray | None) -> Iterator[np.ndarray]:
    data, at = raw_bytes(text)
    for lo, hi in slices(at):
        yield from shingle_sets(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k, shared)
    release()


def _shared(docs: DataFrame, k: int, sample: int) -> np.ndarray:
    """Shingles that several texts of a sample have, sorted."""
    step = max(1, docs.count() // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*shingle_sets(data, at, k), np.zeros(0, np.uint64)]).view(np.int64))], ["s"])

    texts = docs.select(docs["text"].cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)
    often = texts.mapInArrow(run, "s bigint").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED)
    return np.sort(np.array([r.s for r in often.orderBy(F.desc("n"), "s").limit(MOST_SHARED).collect()], np.int64)).view(np.uint64)


def _passes(size: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, limit: tuple[int, int]) -> np.ndarray:
    """Whether sets i and j can reach the limit if this shingle is the first that they share."""
    num, den = limit
    rest = np.minimum(size[i] - pos[i], size[j] - pos[j])
    return rest * (num + den) >= num * (size[i] + size[j])


def bucket_pairs(key: np.ndarray, size: np.ndarray, pos: np.ndarray, limit: tuple[int, int] = LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, crowded) of rows sorted by key: candidate pairs, and the rows of keys with more than BUCKET rows."""
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    n = np.diff(cut)
    begin, many = np.repeat(cut[:-1], n), np.repeat(n, n)
    a, b = [], []
    row = np.flatnonzero((many > 1) & (many <= BUCKET))
    for d in range(1, BUCKET):
        row = row[row + d < begin[row] + many[row]]
        a.append(row)
        b.append(row + d)
    crowded = np.flatnonzero(many > BUCKET)
    for j in [begin[crowded] + h for h in range(HUBS)]:
        ok = (j < crowded) & (j >= begin[crowded])
        a.append(j[ok])
        b.append(crowded[ok])
    i, j = np.concatenate(a), np.concatenate(b)
    ok = _passes(size, pos, i, j, limit)
    return i[ok], j[ok], crowded


def crossed_pairs(key: np.ndarray, size: np.ndarray, pos: np.ndarray, label: np.ndarray, bits: np.ndarray, limit: tuple[int, int] = LIMIT, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of different labels that folded parities do not exclude, of rows sorted by key; parities of zeros exclude none."""
    num, den = limit
    unknown = ~bits.any(1)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        if (label[lo:hi] == label[lo]).all():
            continue
        for left in range(lo, hi, block):
            for right in range(left, hi, block):
                i, j = np.nonzero(label[left : min(hi, left + block), None] != label[None, right : min(hi, right + block)])
                i, j = i + left, j + right
                ok = (i < j) & _passes(size, pos, i, j, limit)
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) * (den + num) <= (size[i] + size[j]) * (den - num)
                ok |= unknown[i] | unknown[j]
                yield i[ok], j[ok]


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first column, cut only where it changes."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        whole = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
        if whole:
            yield [c[:whole] for c in held]
            held = [c[whole:] for c in held]
    if held is not None:
        yield held


def _ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least, most = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((most, least))
    pairs = np.stack([least, most], 1)[order]
    return pairs[np.concatenate([np.ones(min(1, len(pairs)), bool), (pairs[1:] != pairs[:-1]).any(1)])]


def parity(found: np.ndarray) -> np.ndarray:
    """Bits of a set: whether an odd number of its shingles has each place. At least two bits a shingle, a power of two in all."""
    width = max(64, 1 << (2 * len(found)).bit_length())
    return np.packbits((np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(bool), bitorder="little")


def least_difference(a: np.ndarray, b: np.ndarray) -> int:
    """A number of shingles that the two sets surely do not share, from their parities; the wider one is folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def signature(found: np.ndarray, limit: tuple[int, int]) -> bytes:
    """Digest (16 bytes), size, fingerprint and doublings of eight bytes of parity (8 each), the parity, and the prefix of a set."""
    num, den = limit
    votes = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    mark = np.packbits(votes * 2 > len(found), bitorder="little").view(np.uint64)
    bits = parity(found)
    first = len(found) - -(-num * len(found) // den) + 1 if len(found) else 0
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() + np.array([len(found), mark[0], (len(bits) // 8).bit_length() - 1], np.uint64).tobytes() + bits.tobytes() + found[:first].tobytes()


def _numbers(signs: pa.Array) -> np.ndarray:
    """Size, fingerprint and bytes of parity of each signature."""
    found = np.array([np.frombuffer(m, np.int64, 3, 16) for m in signs.to_pylist()], np.int64).reshape(-1, 3)
    found[:, 2] = 8 << found[:, 2]
    return found


def _candidates(marks: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """From (node, marks): pairs (a, b) with key null, and with key the members (a, b = size << 32 | place) of crowded keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            signs = batch.column(1).to_pylist()
            numbers = _numbers(batch.column(1))
            for lo in range(0, len(signs), 500):
                size = numbers[lo : lo + 500, 0]
                some = [np.frombuffer(m, np.int64, offset=40 + k) for m, k in zip(signs[lo : lo + 500], numbers[lo : lo + 500, 2].tolist(), strict=True)]
                n = np.array([len(m) for m in some])
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                key = np.concatenate(some)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(node[lo : lo + 500], n)), pa.array(np.repeat(size << 32, n) | place)], ["key", "node", "at"])
            release()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, at in _whole_keys(batches):
            i, j, crowded = bucket_pairs(key, at >> 32, at & 0xFFFFFFFF, limit)
            pairs = _ordered(node[i], node[j])
            a, b = np.concatenate([pairs[:, 0], node[crowded]]), np.concatenate([pairs[:, 1], at[crowded]])
            k = np.concatenate([np.zeros(len(pairs), np.int64), key[crowded]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(k, mask=np.arange(len(k)) < len(pairs))], ["a", "b", "key"])

    keyed = marks.mapInArrow(emit, "key bigint, node bigint, at bigint")
    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(meet, "a bigint, b bigint, key bigint")


def _folded(sign: bytes, width: int = FOLDED) -> bytes:
    """A signature's parity in so many bytes."""
    bits = np.frombuffer(sign, np.uint8, offset=40)
    if len(bits) < width:  # too narrow to compare with others
        return bytes(width)
    while len(bits) > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits.tobytes()


def _crossed(members: DataFrame, labels: DataFrame, signs: DataFrame, limit: tuple[int, int]) -> DataFrame:
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_folded(m) for m in batch.column(1).to_pylist()], pa.binary())], ["node", "bits"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, at, label, bits in _whole_keys(batches):
            words = np.frombuffer(b"".join(bits.tolist()), np.uint64).reshape(len(bits), -1)
            for i, j in crossed_pairs(key, at >> 32, at & 0xFFFFFFFF, label, words, limit):
                pairs = _ordered(node[i], node[j])
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    folded = signs.join(members.select(F.col("a").alias("node")).distinct(), "node", "left_semi").select("node", "sign").mapInArrow(fold, "node bigint, bits binary")
    named = members.select("key", F.col("a").alias("node"), F.col("b").alias("at")).join(labels, "node", "left").join(folded, "node").select("key", "node", "at", F.coalesce("component", "node").alias("label"), "bits")
    return named.repartition("key").sortWithinPartitions("key", "node").mapInArrow(meet, "a bigint, b bigint")


def _close(pairs: DataFrame, signs: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """The pairs that parities do not exclude."""
    num, den = limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                size = sum(int(np.frombuffer(m, np.int64, 1, 16)[0]) for m in (x, y))
                ok.append(least_difference(*[np.frombuffer(m, np.uint8, offset=40) for m in (x, y)]) * (den + num) <= size * (den - num))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    of = lambda name, column: signs.select(F.col("node").alias(name), F.col("sign").alias(column))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, signs: DataFrame, texts: DataFrame, k: int, limit: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' sets reach the limit."""
    num, den = limit
    close = keep(_close(pairs.distinct(), signs, limit), "similar-pairs")
    nodes = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()

    @F.arrow_udf("binary")
    def as_set(text: pa.Array) -> pa.Array:
        return pa.array([s.tobytes() for s in _by_slices(text, k, None)], pa.binary())

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            found = []
            for a, b, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s = np.frombuffer(s, np.uint64)
                if b is None:
                    hub = s
                    continue
                both = len(np.intersect1d(s, hub, assume_unique=True))
                if both * (num + den) >= num * (len(s) + len(hub)):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    sets = keep(texts.join(nodes, "node", "left_semi").select("node", as_set("text").alias("s")), "similar-sets")
    tasks = close.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("tasks"))
    dealt = close.join(tasks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("task"), "b")
    partners = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "task", "b", "s")
    hubs = tasks.join(sets.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.lit(None).cast("bigint").alias("b"), "s")
    met = hubs.unionByName(partners).repartition("a", "task").sortWithinPartitions("a", "task", F.col("b").asc_nulls_first())
    return met.mapInArrow(reach, "a bigint, b bigint")


def _neighbouring(members: DataFrame, labels: DataFrame, limit: tuple[int, int], turn: int) -> DataFrame:
    """Candidate pairs of different labels at most NEXT apart in a crowded key, in an order of all nodes that each turn draws anew."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, node, at, label in _whole_keys(batches):
            near = []
            for d in range(1, NEXT + 1):
                i = np.flatnonzero((key[d:] == key[:-d]) & (label[d:] != label[:-d]))
                near.append(np.stack([i, i + d]))
            i, j = np.concatenate(near, 1)
            ok = _passes(at >> 32, at & 0xFFFFFFFF, i, j, limit)
            pairs = _ordered(node[i[ok]], node[j[ok]])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    named = members.select("key", F.xxhash64("a", F.lit(turn)).alias("drawn"), F.col("a").alias("node"), F.col("b").alias("at")).join(labels, "node", "left").select("key", "drawn", "node", "at", F.coalesce("component", "node").alias("label"))
    return named.repartition("key").sortWithinPartitions("key", "drawn").mapInArrow(meet, "a bigint, b bigint")


def _simhash_pairs(signs: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with equal fingerprints or such as Golay keys link: each node with the first of its fingerprint, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_numbers(batch.column(1))[:, 1])], ["node", "fp"])

    marked = keep(signs.select("node", "sign").mapInArrow(run, "node bigint, fp bigint"), "similar-marks")
    first = marked.groupBy("fp").agg(F.min("node").alias("least"))
    near = simhash.links(first.select("fp"))
    of = lambda name, column: first.select(F.col("fp").alias(name), F.col("least").alias(column))
    linked = near.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    same = marked.join(first, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return linked.unionByName(same)


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links: components are joined as nodes of a graph of their own, which is much smaller."""
    of = lambda name, column: groups.select(F.col("node").alias(name), F.col("component").alias(column))
    both = links.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    named = keep(both.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")), "similar-joined")
    edges = named.where("x <> y").select("x", "y")
    if edges.isEmpty():
        return groups
    ends = named.select(F.col("a").alias("node"), F.col("x").alias("component")).unionByName(named.select(F.col("b").alias("node"), F.col("y").alias("component")))
    fresh = ends.where("node = component").distinct().join(groups, "node", "left_anti")
    least = connected_components(edges, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("least"))
    merged = groups.unionByName(fresh).join(least, "component", "left")
    return keep(merged.select("node", F.coalesce("least", "component").alias("component")), "similar-groups")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component yet."""
    of = lambda name, column: labels.select(F.col("node").alias(name), F.col("component").alias(column))
    both = pairs.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    return both.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def one_of_similar(docs: DataFrame, k: int = SHINGLE, limit: tuple[int, int] = LIMIT, sample: int = SAMPLE) -> DataFrame:
    """One row of docs for each group of near copies, that of the smallest doc_id (a null one last), with its columns unchanged."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(_shared(docs, k, sample))

    @F.arrow_udf("binary")
    def signed(text: pa.Array) -> pa.Array:
        return pa.array([signature(s, limit) for s in _by_slices(text, k, shared.value)], pa.binary())

    whole = whole_row(docs)
    rows = keep(docs.select(whole, signed(docs["text"].cast("string")).alias("marks"), F.monotonically_increasing_id().alias("node"), docs["doc_id"].cast("bigint").alias("doc_id")).withColumn("same", F.substring("marks", 1, 16)), "similar-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")
    alone = keep(rows.groupBy("same").agg(F.min("node").alias("node"), F.min_by("marks", "node").alias("marks"), first).select("node", "marks", "first"), "similar-distinct")
    length = (8 * F.pow(F.lit(2.0), F.conv(F.hex(F.substring("marks", 33, 1)), 16, 10).cast("double"))).cast("int")  # bytes of parity
    signs = alone.select("node", F.col("marks").substr(F.lit(1), 40 + length).alias("sign"))
    texts = rows.select("node", F.col("row.text").cast("string").alias("text"))
    check = lambda pairs: keep(_verified(pairs, signs, texts, k, limit), "similar-links")
    groups = connected_components(check(_simhash_pairs(signs)))
    found = keep(_candidates(alone.select("node", "marks"), limit), "similar-found")
    groups = _joined(groups, check(_across(found.where("key is null").select("a", "b"), groups)))
    crowded = found.where("key is not null")
    for turn in range(TURNS):
        groups = _joined(groups, check(_neighbouring(crowded, groups, limit, turn)))
    groups = _joined(groups, check(_crossed(crowded, groups, signs, limit)))
    labelled = alone.select("node", "first").join(groups, "node", "left").select(F.coalesce("component", "node").alias("root"), "first")
    kept = keep(labelled.groupBy("root").agg(F.min("first").alias("least")).select(F.col("least.node").alias("node")), "similar-kept")
    return rows.join(kept, "node", "left_semi").select("row.*")

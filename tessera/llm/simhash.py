"""SimHash near-duplicates with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Of at most
two differing bits, some pair of segments holds at most one: one segment of
the pair is equal and the other differs in at most one bit. The second is
decoded, with every word one bit away, by the perfect (23,12) Golay code; two
words one bit apart always share one of these codeword numbers (one or six
for each word). Equal segment and codeword number make a key; fingerprints
that share a key are verified bit by bit. Only distinct fingerprints take
part, and a bucket gives a spanning forest of its verified links, never all
of its pairs; a bucket of more than SPLIT fingerprints, as of a family of
templates, is dealt again by parts of the segment that its key leaves out.
Connected components over these links finish the job.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; texts of one or two words have one shingle; very long texts are
voted on whole, a bounded number of shingles at a time; equal texts and
repeated rows share a fingerprint; a component of null ids only has a null
component id; other columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import LOWER, blocks, bounded_batches, mix, raw_bytes, release, text_frame, whole_row
from tessera.operators.graph import connected_components
from tessera.session import keep

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Generator of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Shingles voted on at a time.
VOTES = 1 << 16
#: Fingerprints of a bucket that one task holds; those of larger buckets get narrower keys and meet again.
SPLIT = 20_000


def fingerprint(words: list[bytes], k: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    end = end.tolist()
    n = max(1, len(words) - k + 1)
    stop = end[k - 1 :] if len(words) >= k else end[-1:]
    digest, votes = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, n, VOTES):
        hi = min(n, lo + VOTES)
        found = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(start[lo:hi], stop[lo:hi], strict=True)), np.uint64, hi - lo)
        votes += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in blocks(batches):
            low = LOWER[data].tobytes()
            found = np.array([fingerprint(low[a:b].split(), k) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _remainders() -> np.ndarray:
    """Remainder modulo GOLAY of v << 11 for the 4096 information words v."""
    word = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        word = np.where((word >> bit) & 1, word ^ (GOLAY << (bit - 11)), word)
    return word


def _errors(rem: np.ndarray) -> np.ndarray:
    """The one pattern of at most three wrong bits for each of the 2048 syndromes."""
    out = np.zeros(2048, np.int64)
    ones = [1 << i for i in range(23)]
    patterns = [0, *ones, *[a | b for i, a in enumerate(ones) for b in ones[:i]], *[a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]]]
    for e in patterns:
        out[rem[e >> 11] ^ (e & 2047)] = e
    return out


_REM = _remainders()
_ERR = _errors(_REM)


def codeword(x: np.ndarray) -> np.ndarray:
    """Number of the codeword within three bits of each 23-bit word."""
    return (x ^ _ERR[_REM[x >> 11] ^ (x & 2047)]) >> 11


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fp, key) of every key; any two fingerprints within two bits share one."""
    fp = fp.view(np.uint64)
    parts = [((fp >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    at, keys, family = [], [], 0
    for j in range(3):
        near = np.stack([codeword(parts[j]), *[codeword(parts[j] ^ (1 << b)) for b in range(SEGMENTS[j][1])]], 1)
        near.sort(axis=1)
        first = np.ones(near.shape, bool)
        first[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(first)
        for i in range(3):
            if i != j:
                at.append(row)
                keys.append((family << 40) | (parts[i][row] << 12) | near[row, col])
                family += 1
    return np.concatenate(at), np.concatenate(keys)


def _forest(fp: np.ndarray, block: int = 512) -> tuple[list[int], list[int]]:
    """Spanning forest of the links within one bucket of distinct fingerprints."""
    parent = list(range(len(fp)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a, b = [], []
    for lo in range(0, len(fp), block):
        for left in range(0, lo + 1, block):
            close = np.bitwise_count(fp[lo : lo + block, None] ^ fp[None, left : left + block]) <= MOST_BITS
            for i, j in zip(*np.nonzero(close), strict=True):
                i, j = int(i) + lo, int(j) + left
                if i > j and (p := root(i)) != (q := root(j)):
                    parent[p] = q
                    a.append(i)
                    b.append(j)
    return a, b


def bucket_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside the buckets of rows that are sorted by key."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
    size = np.diff(cut)
    bits = fp.view(np.uint64)
    a, b = [], []
    pairs = cut[:-1][size == 2]
    close = np.bitwise_count(bits[pairs] ^ bits[pairs + 1]) <= MOST_BITS
    a.append(pairs[close])
    b.append(pairs[close] + 1)
    for k in np.flatnonzero(size > 2):
        lo, hi = cut[k], cut[k + 1]
        if hi - lo <= 24:
            i, j = np.triu_indices(hi - lo, 1)
            near = np.bitwise_count(bits[lo + i] ^ bits[lo + j]) <= MOST_BITS
            if near.any():
                x, y = _forest(bits[lo:hi])
                a.append(lo + np.array(x, int))
                b.append(lo + np.array(y, int))
        else:
            x, y = _forest(bits[lo:hi])
            a.append(lo + np.array(x, int))
            b.append(lo + np.array(y, int))
    return fp[np.concatenate(a).astype(int)], fp[np.concatenate(b).astype(int)]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between the distinct fingerprints in column fp that connect all who are within two bits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for lo in range(0, len(fp), 20_000):
                at, keys = fuzzy_keys(fp[lo : lo + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[lo : lo + 20_000][at])], ["key", "fp"])

    keyed = distinct.select("fp").mapInArrow(emit, "key bigint, fp bigint")
    met = keep(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(SPLIT), MET), "simhash-met")
    again = met.where("key is not null").select("key", F.col("a").alias("fp")).repartition("key").sortWithinPartitions("key")
    return met.where("key is null").select("a", "b").unionByName(again.mapInArrow(_meet(None), MET).select("a", "b"))


MET = "a bigint, b bigint, key bigint"


def split_keys(key: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp): narrower keys of the fingerprints of a crowded bucket, three each.

    Two of them within two bits of each other have one of three parts of the segment that the key leaves out in common.
    """
    j, i = [(j, i) for j in range(3) for i in range(3) if i != j][key >> 40]
    begin, width = SEGMENTS[3 - i - j]
    cut = [begin + width * part // 3 for part in range(4)]
    parts = [(fp.view(np.uint64) >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
    keys = [mix(mix(np.full(len(fp), key * 3 + n, np.uint64)) ^ part) for n, part in enumerate(parts)]
    return np.concatenate(keys).view(np.int64), np.tile(fp, 3)


def _meet(split: int | None):
    """Links of buckets of rows sorted by key; buckets of more than `split` rows pass on as rows with narrower keys, never held whole."""

    def linked(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = bucket_links(key, fp)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])

    def passed(key: int, fp: np.ndarray) -> pa.RecordBatch:
        keys, again = split_keys(key, fp)
        return pa.RecordBatch.from_arrays([pa.array(again), pa.nulls(len(again), pa.int64()), pa.array(keys)], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, crowded = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if crowded is not None:
                n = int(np.searchsorted(k, crowded, "right"))
                if n:
                    yield passed(crowded, f[:n])
                k, f = k[n:], f[n:]
            if not len(k):
                continue
            crowded = None
            held_k, held_f = np.concatenate([held_k, k]), np.concatenate([held_f, f])
            whole = int(np.searchsorted(held_k, held_k[-1], "left"))
            yield linked(held_k[:whole], held_f[:whole])
            held_k, held_f = held_k[whole:], held_f[whole:]
            if split is not None and len(held_k) > split:
                crowded = int(held_k[0])
                yield passed(crowded, held_f)
                held_k, held_f = held_k[:0], held_f[:0]
        yield linked(held_k, held_f)

    return run


def components(distinct: DataFrame) -> DataFrame:
    """(fp, least) from (fp, first), one row a fingerprint: the least `first` of all that fp is linked with."""
    distinct = keep(distinct, "simhash-distinct")
    found = connected_components(links(distinct))
    labelled = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    return labelled.join(labelled.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", "least")


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of (doc_id, text)."""
    marked = keep(fingerprints(text_frame(docs), k), "simhash")
    groups = keep(components(marked.groupBy("fp").agg(F.min("doc_id").alias("first"))), "simhash-groups").withColumnRenamed("least", "component_id")
    return marked.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, k: int = SHINGLE, similarity: tuple[int, int] | None = None) -> DataFrame:
    """One row of docs for each component, that of the smallest doc_id (a null one last), with its columns unchanged.

    With a similarity (a fraction) links are those of shingle sets that reach it: fingerprints' links
    are verified on the sets, and links that fingerprints miss are found exactly.
    """
    if similarity is not None:
        from tessera.llm import similar

        return similar.one_of_similar(docs, k, similarity)
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def marked(text: pa.Array) -> pa.Array:
        data, at = raw_bytes(text)
        low = LOWER[data].tobytes()
        found = [fingerprint(low[a:b].split(), k) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        release()
        return pa.array(np.array(found, np.uint64).view(np.int64))

    rows = keep(docs.select(whole_row(docs), marked(docs["text"].cast("string")).alias("fp"), F.monotonically_increasing_id().alias("place"), docs["doc_id"].cast("bigint").alias("doc_id")), "simhash-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("first")
    kept = keep(components(rows.groupBy("fp").agg(first)).select(F.col("least.place").alias("place")).distinct(), "simhash-kept")
    return rows.join(kept, "place", "left_semi").select("row.*")

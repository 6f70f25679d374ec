"""Whole texts as byte blocks: the shared vectorised base of the text operators."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship

#: Bytes of text that a vectorised step holds at a time. A single longer text makes a block of its own.
BLOCK_BYTES = 2 << 20
#: Whitespace of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: An odd base for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Odd factors of the hash of spans.
ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
#: Spans up to so many bytes are hashed together, eight bytes at a time.
SHORT = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
WORDS = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to a few MB, however long the texts are; and see that the executors have the code."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def crc_mod(column: str, n: int):
    """crc32 of the id's decimal text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def text_frame(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """doc_id and text under fixed names, whatever else the table has; `more` adds columns."""
    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[c.alias(k) for k, c in more.items()])


def whole_row(docs: DataFrame):
    """All columns as one struct named row, whatever they are called."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("row")


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array and the n+1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def slices(at: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """First and last text of each run of texts of about `limit` bytes."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(at, at[lo] + (limit or BLOCK_BYTES), "right")) - 1))
        yield lo, hi
        lo = hi


#: What tasks of one operator remember for its next ones; those of another operator drop it.
memos: list[dict] = []


def release(own: dict | None = None) -> None:
    """Drop the memos of other operators, and hand freed memory back to the system; a worker's heap otherwise keeps the largest block's."""
    for memo in memos:
        if memo is not own:
            memo.clear()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it keeps


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their texts' bytes and offsets, each of about BLOCK_BYTES."""
    for batch in batches:
        data, at = raw_bytes(batch.column(batch.schema.get_field_index("text")))
        for lo, hi in slices(at):
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        release()


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; grown in doublings and reused."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = 1 << max(10, int(n).bit_length())
        out = np.ones(size + 1, np.uint64)
        np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]), out=out)
        _powers[base] = have = out
    return have[: n + 1]


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """H with H[j]-H[i] = sum of (byte+1) * base**k for k in i..j-1, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), base)[:-1] if len(data) else np.zeros(0, np.uint64), out=out[1:])
    return out


def distinct_sorted(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort; np.unique without counts goes through a slower hash table."""
    a = np.sort(a)
    return a[np.concatenate([np.ones(min(1, len(a)), bool), a[1:] != a[:-1]])]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE, inverse: int = BASE_INV) -> np.ndarray:
    """Hashes of the byte spans, equal for equal bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), inverse)[start] + (end - start).astype(np.uint64))


def span_words(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two non-linear hashes of each span, of 64 and 32 bits, which together tell spans apart."""
    size = last - first
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    one, two = size.astype(np.uint64) * ODD[0], size.astype(np.uint64) * ODD[1]
    rest = np.arange(len(first))
    for k in range(0, SHORT, 8):
        rest = rest[size[rest] > k]
        if not len(rest):
            break
        lane = lanes[first[rest] + k] & _MASK[np.minimum(size[rest] - k, 8)]
        one[rest] = mix(one[rest] ^ lane) * ODD[2]
        two[rest] = mix(two[rest] + lane * ODD[0]) + one[rest]
    for i in np.flatnonzero(size > SHORT).tolist():
        digest = hashlib.blake2b(data[first[i] : last[i]].tobytes(), digest_size=16).digest()
        one[i], two[i] = np.frombuffer(digest, "<u8")
    return one, (two >> np.uint64(32)).astype(np.uint32)


def word_spans(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and its text's number; words never cross texts. space marks the bytes that no word holds."""
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values by text."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]

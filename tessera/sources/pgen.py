"""Hardcalls of PGEN files: a Python data source over ranges of variants.

The driver reads the fixed header and one offset for each block of 65,536
variants. A partition is a range of variants inside a block; its task reads the
types and lengths of the block's records, moves both ends of its range on to
the next record that is not coded against an earlier one, and so decodes every
record once. Difference lists and records coded against the last such base are
resolved on two-bit codes in numpy, some variants at a time. Where only the
called samples are asked for, records that list them are read as lists, without
a value for every other sample. The path must be one that executors can open.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: First bytes, variants of a block, and the storage modes read here (fixed format).
PGEN_MAGIC, BLOCK = b"\x6c\x1b", 1 << 16
PLINK1, FIXED, VARIABLE = 1, 2, 16
#: Record types by their low three bits (fixed format): plain codes, two values and a list of others, against the base, that one with 0 and 2 exchanged; from 4 on one common value and a list of others.
PLAIN, TWO_VALUES, AGAINST_BASE, EXCHANGED = 0, 1, 2, 3
#: Values of a batch, and the records of one of called samples.
BATCH_VALUES, BATCH_RECORDS = 4 << 20, 4096
#: The type of a record that lists the samples not missing, and the part of the samples that a list may hold (fixed format).
MISSING_BUT, LIST_SHARE = 7, 8


@dataclass
class PgenHead:
    mode: int
    variants: int
    samples: int
    #: Bytes of a record's length, whether types take a byte each, bytes of an allele count, how reference flags are stored.
    length_bytes: int = 0
    wide_types: bool = False
    allele_bytes: int = 0
    flags: int = 0

    @property
    def stride(self) -> int:
        return -(-self.samples // 4)

    @property
    def blocks(self) -> int:
        return -(-self.variants // BLOCK)


def read_head(path: str) -> PgenHead:
    with open(path, "rb") as f:
        first = f.read(12)
    if len(first) < 12 or first[:2] != PGEN_MAGIC or first[2] not in (FIXED, VARIABLE):
        raise ValueError("not a PGEN file of fixed or variable width")
    head = PgenHead(first[2], int.from_bytes(first[3:7], "little"), int.from_bytes(first[7:11], "little"))
    if head.mode == VARIABLE:
        kind = first[11] & 15
        if kind > 7:
            raise ValueError(f"record lengths of kind {kind}")
        head.length_bytes, head.wide_types, head.allele_bytes, head.flags = kind % 4 + 1, kind > 3, first[11] >> 4 & 3, first[11] >> 6
    elif os.path.getsize(path) != 12 + head.stride * head.variants:
        raise ValueError(f"{os.path.getsize(path)} bytes for {head.variants} variants of {head.samples} samples")
    return head


def block_offsets(path: str, head: PgenHead) -> list[int]:
    with open(path, "rb") as f:
        f.seek(12)
        return np.frombuffer(f.read(8 * head.blocks), "<u8").astype(np.int64).tolist()


def _types_and_lengths(f, head: PgenHead, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the block's records; all blocks' entries before the last one's have one size."""
    size = lambda n: (n if head.wide_types else -(-n // 2)) + n * (head.length_bytes + head.allele_bytes) + (-(-n // 8) if head.flags == 3 else 0)
    n = min(BLOCK, head.variants - block * BLOCK)
    f.seek(12 + 8 * head.blocks + block * size(BLOCK))
    raw = np.frombuffer(f.read(n if head.wide_types else -(-n // 2)), np.uint8)
    types = raw if head.wide_types else np.stack([raw & 15, raw >> 4], axis=1).ravel()[:n]
    lengths = np.zeros((n, 8), np.uint8)
    lengths[:, : head.length_bytes] = np.frombuffer(f.read(n * head.length_bytes), np.uint8).reshape(n, head.length_bytes)
    return types, lengths.view("<i8").ravel()


def unpack_codes(raw: np.ndarray, n: int) -> np.ndarray:
    """n two-bit codes, from the low bits of each byte up."""
    return (raw[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()[:n]


def _varints(data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The first n variable-length numbers, and how many bytes they take."""
    ends = np.flatnonzero(data < 128)[:n]
    if len(ends) < n:
        raise ValueError("a difference list ends early")
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(ends[-1] + 1) - np.repeat(begins, ends - begins + 1)
    return np.add.reduceat((data[: ends[-1] + 1] & 127).astype(np.int64) << 7 * place, begins), int(ends[-1]) + 1


def difference_list(data: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Sample numbers and codes of a list: groups of 64 with an absolute first number each, then steps."""
    if not len(data):
        raise ValueError("a difference list is missing")
    (n,), at = _varints(data, 1)
    n = int(n)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    groups, width = -(-n // 64), (samples.bit_length() + 7) // 8
    firsts = np.zeros((groups, 8), np.uint8)
    firsts[:, :width] = data[at : at + groups * width].reshape(groups, width)
    at += groups * width + groups - 1  # the groups' sizes in bytes are for readers that skip
    codes = unpack_codes(data[at : at + -(-n // 4)], n)
    at += -(-n // 4)
    numbers = np.zeros(n, np.int64)
    numbers[::64] = firsts.view("<i8").ravel()
    inner = np.arange(n) % 64 != 0
    if inner.any():
        numbers[inner] = _varints(data[at:], int(inner.sum()))[0]
    total = np.cumsum(numbers)
    heads = np.arange(0, n, 64)
    numbers = total - np.repeat(total[heads] - numbers[heads], np.diff(np.append(heads, n)))
    if numbers[-1] >= samples or (np.diff(numbers) <= 0).any():
        raise ValueError("a difference list is out of order")
    return numbers, codes


def _as_varints(numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Variable-length numbers, none negative, and the bytes that each takes."""
    size = np.ones(len(numbers), np.int64)
    for bits in range(7, 35, 7):
        size += numbers >> bits > 0
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    low = np.repeat(numbers, size) >> 7 * place & 127
    return (low | np.where(place < np.repeat(size, size) - 1, 128, 0)).astype(np.uint8).tobytes(), size


def encoded_calls(places: np.ndarray, codes: np.ndarray, samples: int) -> tuple[int, bytes]:
    """Type and bytes of a record of called samples, by ascending number; the others are missing.

    They are listed where the format allows lists, for up to an eighth of the samples, and that is shorter; else all codes follow plainly.
    """
    n = len(places)
    if n and (places[0] < 0 or places[-1] >= samples or (np.diff(places) <= 0).any() or codes.min() < 0 or codes.max() > 2):
        raise ValueError("calls are out of order, outside the samples, or not 0, 1 or 2")
    if n <= samples // LIST_SHARE:
        width, heads = (samples.bit_length() + 7) // 8, places[::64].astype("<i8")
        steps, size = _as_varints(np.diff(places)[np.arange(1, n) % 64 != 0] if n else places)
        groups = np.add.reduceat(size, np.arange(0, len(size), 63)) if len(size) else size
        packed = np.zeros(-(-n // 4) * 4, np.uint8)
        packed[:n] = codes
        packed = (packed.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
        data = _as_varints(np.array([n]))[0] + heads.view(np.uint8).reshape(-1, 8)[:, :width].tobytes() + (groups[: len(heads) - 1] - 63).astype(np.uint8).tobytes() + packed.tobytes() + steps
        if len(data) <= -(-samples // 4):
            return MISSING_BUT, data
    plain = np.full(-(-samples // 4) * 4, 3, np.uint8)
    plain[samples:] = 0
    plain[places] = codes
    return PLAIN, (plain.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()


def decode_record(kind: int, data: np.ndarray, samples: int, base: np.ndarray | None) -> np.ndarray:
    """Two-bit codes (alternate alleles, 3 for missing) of one record's hardcalls; tracks after them are not read."""
    kind &= 7
    if kind == PLAIN:
        return unpack_codes(data[: -(-samples // 4)], samples).copy()
    if kind in (AGAINST_BASE, EXCHANGED):
        if base is None:
            raise ValueError("a record has no base")
        codes, rest = base.copy(), data
    elif kind == TWO_VALUES:
        low, step, n_bytes = data[0] // 4, data[0] & 3, -(-samples // 8)
        codes = (low + step * np.unpackbits(data[1 : 1 + n_bytes], bitorder="little")[:samples]).astype(np.uint8)
        rest = data[1 + n_bytes :]
    elif kind == 5:
        raise ValueError("record type 5 is reserved")
    else:
        codes, rest = np.full(samples, kind & 3, np.uint8), data
    who, what = difference_list(rest, samples)
    codes[who] = what
    return np.array([2, 1, 0, 3], np.uint8)[codes] if kind == EXCHANGED else codes


def is_base(types: np.ndarray) -> np.ndarray:
    return (types & 6) != AGAINST_BASE


class _Variants(InputPartition):
    def __init__(self, block: int, offset: int, first: int, stop: int):
        self.block, self.offset, self.first, self.stop = block, offset, first, stop


class PgenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows, self.missing = options["path"], int(options.get("rows", 4096)), options.get("missing", "-1")
        if self.rows < 1 or self.missing not in ("-1", "null"):
            raise ValueError("rows is at least 1; missing is -1 or null")
        self.head = read_head(self.path)

    def partitions(self) -> list[InputPartition]:
        """Ranges of a block's variants, the block's numbers as they stand before the ends move to base records."""
        at = [12 + self.head.stride * BLOCK * b for b in range(self.head.blocks)] if self.head.mode == FIXED else block_offsets(self.path, self.head)
        sizes = [min(BLOCK, self.head.variants - b * BLOCK) for b in range(self.head.blocks)]
        return [_Variants(b, at[b], lo, min(lo + self.rows, n)) for b, n in enumerate(sizes) for lo in range(0, n, self.rows)]

    def _raw(self, part: _Variants) -> Iterator[tuple[int, int, np.ndarray]]:
        """(variant, type, bytes) of the partition's records."""
        first, stop = part.first, part.stop
        with open(self.path, "rb") as f:
            if self.head.mode == FIXED:
                types, lengths = np.zeros(stop, np.uint8), np.full(stop, self.head.stride, np.int64)
            else:
                types, lengths = _types_and_lengths(f, self.head, part.block)
                bases = np.flatnonzero(is_base(types))
                if not len(bases) or bases[0]:
                    raise ValueError("a block does not begin with a base record")
                on = np.append(bases, len(types))
                first, stop = (int(on[np.searchsorted(on, x)]) for x in (first, stop))
            at = np.concatenate([[0], np.cumsum(lengths)])
            f.seek(part.offset + int(at[first]))
            for i in range(first, stop):
                data = np.frombuffer(f.read(int(lengths[i])), np.uint8)
                if len(data) < lengths[i]:
                    raise ValueError("the file ends early")
                yield part.block * BLOCK + i, int(types[i]), data

    def records(self, part: _Variants) -> Iterator[tuple[int, np.ndarray]]:
        """(variant, codes) of the partition."""
        base = None
        for variant, kind, data in self._raw(part):
            codes = decode_record(kind, data, self.head.samples, base)
            if (kind & 6) != AGAINST_BASE:
                base = codes
            yield variant, codes

    def called(self, part: _Variants) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(variant, samples, codes) of the samples that are not missing; all samples' codes are made only for records that do not list these."""
        n, base, held = self.head.samples, None, None
        for variant, kind, data in self._raw(part):
            if kind & 7 == MISSING_BUT:
                base, held = None, (kind, data)
                who, what = difference_list(data, n)
            else:
                if base is None and held is not None and (kind & 6) == AGAINST_BASE:
                    base = decode_record(*held, n, None)
                all_codes = decode_record(kind, data, n, base)
                if (kind & 6) != AGAINST_BASE:
                    base, held = all_codes, None
                who, what = np.arange(n), all_codes
            known = what != 3
            yield variant, who[known], what[known]

    def read(self, part: _Variants) -> Iterator[pa.RecordBatch]:
        most, ids, rows = max(1, BATCH_VALUES // max(1, self.head.samples)), [], []
        for variant, codes in self.records(part):
            ids.append(variant)
            rows.append(codes)
            if len(ids) == most:
                yield self._batch(ids, rows)
                ids, rows = [], []
        if ids:
            yield self._batch(ids, rows)

    def _batch(self, ids: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        dosage = np.array([0, 1, 2, -1], np.int8)[np.concatenate(rows)]
        values = pa.array(dosage, pa.int8(), mask=dosage < 0) if self.missing == "null" else pa.array(dosage, pa.int8())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * self.head.samples), values)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["variant_index", "dosages"])


class PgenSource(DataSource):
    """spark.read.format("pgen").load(path): variant_index, dosages (alternate alleles; -1, or null on demand, for missing)."""

    @classmethod
    def name(cls) -> str:
        return "pgen"

    def schema(self) -> str:
        return "variant_index bigint, dosages array<tinyint>"

    def reader(self, schema) -> PgenReader:
        return PgenReader(self.options)


class CalledReader(PgenReader):
    def read(self, part: _Variants) -> Iterator[pa.RecordBatch]:
        ids, who, what, values = [], [], [], 0
        for variant, places, codes in self.called(part):
            ids.append(variant)
            who.append(places)
            what.append(codes)
            values += len(places)
            if values >= BATCH_VALUES or len(ids) == BATCH_RECORDS:
                yield _called_batch(ids, who, what)
                ids, who, what, values = [], [], [], 0
        if ids:
            yield _called_batch(ids, who, what)


def _called_batch(ids: list[int], who: list[np.ndarray], what: list[np.ndarray]) -> pa.RecordBatch:
    ends = pa.array(np.concatenate([[0], np.cumsum([len(w) for w in who])]).astype(np.int32))
    places = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(who).astype(np.int32)))
    dosages = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(what).astype(np.int8)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), places, dosages], ["variant_index", "places", "dosages"])


class CalledSource(DataSource):
    """format("pgen_called"): variant_index, places (the numbers, from 0, of the samples called), dosages (theirs)."""

    @classmethod
    def name(cls) -> str:
        return "pgen_called"

    def schema(self) -> str:
        return "variant_index bigint, places array<int>, dosages array<tinyint>"

    def reader(self, schema) -> CalledReader:
        return CalledReader(self.options)


def read_called(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """The calls of a PGEN file, without a value for samples that are missing."""
    spark.dataSource.register(CalledSource)
    return spark.read.format("pgen_called").option("rows", rows).load(path)


def read_pgen(spark: SparkSession, path: str, rows: int = 4096, missing: str = "-1") -> DataFrame:
    spark.dataSource.register(PgenSource)
    return spark.read.format("pgen").option("rows", rows).option("missing", missing).load(path)


def read_pvar(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a PVAR file with their place in it: variant_index, chrom, pos, variant_id, ref, alt."""
    from tessera.sources.genotypes import _numbered

    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("#") & ~F.col("value").startswith("##")).first()
    if head is None or head[0].lstrip("#").split("\t")[:5] != ["CHROM", "POS", "ID", "REF", "ALT"]:
        raise ValueError("not a PVAR header")
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return _numbered(rows, "variant_index").select("variant_index", f[0].alias("chrom"), f[1].cast("bigint").alias("pos"), f[2].alias("variant_id"), f[3].alias("ref"), f[4].alias("alt"))


def pvar_problems(variants: DataFrame, chrom: str, expected: int) -> DataFrame:
    """(problem, rows) of a PVAR table: other chromosomes, positions that fall, more than one alternate, repeated ids, another count."""
    from tessera.operators.numbering import in_ranges

    ranges = in_ranges(variants, "variant_index")
    inside = Window.partitionBy("__range").orderBy("variant_index")
    falls = ranges.withColumn("__last", F.lag("pos").over(inside)).where(F.col("pos") < F.col("__last"))
    ends = ranges.groupBy("__range").agg(F.min_by("pos", "variant_index").alias("a"), F.max_by("pos", "variant_index").alias("b"))
    over = ends.withColumn("__last", F.lag("b").over(Window.orderBy("__range"))).where(F.col("a") < F.col("__last"))  # one row a range
    repeats = variants.groupBy("variant_id").count().where("count > 1")
    counted = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("problem"), "rows")
    off = variants.agg(F.count("*").alias("rows")).where(F.col("rows") != expected).select(F.lit("count").alias("problem"), "rows")
    parts = [counted(variants.where(~F.col("chrom").eqNullSafe(F.lit(chrom))), "chromosome"), counted(falls.select("pos").unionByName(over.select(F.col("a").alias("pos"))), "order"), counted(variants.where(F.col("alt").contains(",")), "alternates"), counted(repeats, "repeated id")]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.where("rows > 0").unionByName(off)

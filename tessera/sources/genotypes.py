"""Genotype files: PLINK sets, VCF text, BGEN headers and NPY matrices.

PLINK's packed matrix is a Python data source whose partitions are ranges of
variants, each read by one seek; the path must be one that executors can open.
PGEN and SAS files need libraries that are not here; convert them to Parquet.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.values import dosage_of

#: First bytes of a variant-major matrix, and copies of the first allele by two-bit code; -1 is missing (fixed values).
MAGIC = bytes([0x6C, 0x1B, 0x01])
COPIES = (2, -1, 1, 0)
#: A byte of four missing samples (fixed format), and the bytes of a matrix that a task looks through at a time.
ALL_MISSING, CHUNK = 0x55, 4 << 20
#: Lengths of a BGEN file's fixed header fields (fixed format): offset, header length, variants, samples, magic.
BGEN_HEAD = "<IIII4s"


def decode(packed: np.ndarray, n: int) -> np.ndarray:
    """Dosages of n samples from rows of packed bytes, four samples a byte from the low bits up."""
    codes = (packed[..., None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return np.array(COPIES, np.int8)[codes.reshape(*packed.shape[:-1], -1)[..., :n]]


def count_lines(path: str) -> int:
    with open(path, "rb") as f:
        return sum(1 for line in f if line.strip())


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _PlinkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.stem, self.rows = options["path"], int(options.get("rows", 4096))
        self.samples, self.variants = count_lines(f"{self.stem}.fam"), count_lines(f"{self.stem}.bim")
        self.stride = -(-self.samples // 4)
        size = os.path.getsize(f"{self.stem}.bed")
        with open(f"{self.stem}.bed", "rb") as f:
            if f.read(3) != MAGIC:
                raise ValueError("not a variant-major matrix")
        if size != 3 + self.stride * self.variants:
            raise ValueError(f"{size} bytes for {self.variants} variants of {self.samples} samples")

    def partitions(self) -> list[InputPartition]:
        return [_Range(lo, min(self.rows, self.variants - lo)) for lo in range(0, self.variants, self.rows)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        with open(f"{self.stem}.bed", "rb") as f:
            f.seek(3 + self.stride * part.first)
            packed = np.frombuffer(f.read(self.stride * part.count), np.uint8).reshape(part.count, self.stride)
        found = decode(packed, self.samples)
        flat = pa.array(found.ravel(), pa.int8(), mask=found.ravel() < 0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(part.count + 1, dtype=np.int32) * self.samples), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.first + part.count)), lists], ["variant_index", "dosages"])


class PlinkSource(DataSource):
    """spark.read.format("plink").load(stem): variant_index, dosages."""

    @classmethod
    def name(cls) -> str:
        return "plink"

    def schema(self) -> str:
        return "variant_index bigint, dosages array<tinyint>"

    def reader(self, schema) -> _PlinkReader:
        return _PlinkReader(self.options)


class _CalledReader(_PlinkReader):
    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        stride, most = max(1, self.stride), max(1, CHUNK // max(1, self.stride))
        with open(f"{self.stem}.bed", "rb") as f:
            f.seek(3 + self.stride * part.first)
            for first in range(part.first, part.first + part.count, most):
                rows = min(most, part.first + part.count - first)
                packed = np.frombuffer(f.read(self.stride * rows), np.uint8)
                at = np.flatnonzero(packed != ALL_MISSING)
                copies = np.array(COPIES, np.int8)[packed[at][:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3]
                place = (at % stride * 4)[:, None] + np.arange(4)
                known = (copies >= 0) & (place < self.samples)  # a row's last byte is filled up
                ends = np.zeros(rows + 1, np.int64)
                np.cumsum(np.bincount(np.repeat(at // stride, known.sum(axis=1)), minlength=rows), out=ends[1:])
                offsets = pa.array(ends.astype(np.int32))
                places, dosages = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (place[known].astype(np.int32), copies[known]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + rows)), places, dosages], ["variant_index", "places", "dosages"])


class PlinkCalledSource(DataSource):
    """format("plink_called"): variant_index, places (the numbers, from 0, of the samples called), dosages (theirs)."""

    @classmethod
    def name(cls) -> str:
        return "plink_called"

    def schema(self) -> str:
        return "variant_index bigint, places array<int>, dosages array<tinyint>"

    def reader(self, schema) -> _CalledReader:
        return _CalledReader(self.options)


def read_plink_called(spark: SparkSession, stem: str, rows: int = 4096) -> DataFrame:
    """The calls of a PLINK set, without a value for samples that are missing; the packed bytes are all read."""
    spark.dataSource.register(PlinkCalledSource)
    return spark.read.format("plink_called").option("rows", rows).load(stem)


def read_plink(spark: SparkSession, stem: str, rows: int = 4096) -> DataFrame:
    spark.dataSource.register(PlinkSource)
    return spark.read.format("plink").option("rows", rows).load(stem)


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """Variants with their place in the file; the file is read as one ordered stream."""
    rows = spark.read.csv(path, sep="\t", schema="chrom string, variant_id string, cm double, pos long, a1 string, a2 string")
    return _numbered(rows, "variant_index")


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(*[F.get(f, F.lit(i)).alias(c) for i, c in enumerate(("fid", "iid", "father", "mother", "sex", "phenotype"))])
    return _numbered(rows, "sample_index")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows with their number in file order, by partition counts and an offset for each."""
    tagged = rows.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i"))
    sizes = sorted((r["__p"], r["count"]) for r in tagged.groupBy("__p").count().collect())
    offsets, total = {}, 0
    for p, n in sizes:
        offsets[p], total = total, total + n
    offset = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("__p")] if offsets else F.lit(0)
    return tagged.withColumn(name, (offset + F.col("__i") - F.shiftleft(F.col("__p").cast("bigint"), 33)).cast("bigint")).drop("__p", "__i")


def variant_summary(variants: DataFrame) -> DataFrame:
    """By chromosome: variants, first and last position, single-base variants."""
    return variants.groupBy("chrom").agg(F.count("*").alias("variants"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count_if((F.length("a1") == 1) & (F.length("a2") == 1)).alias("single_base"))


def sample_summary(samples: DataFrame) -> DataFrame:
    """One row: samples, withdrawn ones (negative ids), repeated ids, and counts by sex."""
    return samples.agg(F.count("*").alias("samples"), F.count_if(F.col("iid").startswith("-")).alias("negative"), (F.count("iid") - F.count_distinct("iid")).alias("repeated"), *[F.count_if(F.col("sex") == s).alias(f"sex_{s}") for s in ("1", "2")])


def long_genotypes(dosages: DataFrame, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """(variant_id, chrom, pos, sample, dosage), by index and never by order."""
    long = dosages.select("variant_index", F.posexplode("dosages").alias("sample_index", "dosage"))
    return long.join(variants.select("variant_index", "variant_id", "chrom", "pos"), "variant_index").join(samples.select("sample_index", F.col("iid").alias("sample")), "sample_index").select("variant_id", "chrom", "pos", "sample", "dosage")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """VCF text as (chrom, pos, id, ref, alt, sample, gt, phased, dosage); dosage of diploid 0/1 calls only."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("#CHROM")).first()
    if head is None:
        raise ValueError("no #CHROM line")
    names = head[0].split("\t")[9:]
    f = F.split("value", "\t")
    fixed = {"chrom": 0, "id": 2, "ref": 3, "alt": 4}
    rows = lines.where(~F.col("value").startswith("#")).select(*[f[i].alias(n) for n, i in fixed.items()], f[1].cast("bigint").alias("pos"), F.posexplode(F.slice(f, 10, max(1, len(names)))).alias("k", "call"))
    gt = F.substring_index("call", ":", 1)
    alleles = F.split(gt, r"[/|]")
    allele = lambda i: F.get(alleles, F.lit(i)).try_cast("int")
    sample = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    return rows.select("chrom", "pos", "id", "ref", "alt", sample.alias("sample"), gt.alias("gt"), gt.contains("|").alias("phased"), F.when(F.size(alleles) == 2, dosage_of(allele(0), allele(1))).alias("dosage"))


def phase_audit(vcf: DataFrame, sites: int = 100) -> DataFrame:
    """Called genotypes of the first sites, how many are phased, and their share (null if none is called)."""
    first = vcf.select("chrom", "pos").distinct().orderBy("chrom", "pos").limit(sites)
    rows = vcf.join(first, ["chrom", "pos"], "left_semi").where(F.col("dosage").isNotNull())
    return rows.agg(F.count("*").alias("called"), F.count_if("phased").alias("phased")).withColumn("share", F.try_divide("phased", "called"))


def bgen_header(first: bytes) -> dict[str, int]:
    """Counts, compression, layout and id flag from a BGEN file's first bytes."""
    offset, length, variants, samples, magic = struct.unpack_from(BGEN_HEAD, first)
    if magic not in (b"bgen", b"\0\0\0\0"):
        raise ValueError("not a BGEN header")
    flags = struct.unpack_from("<I", first, 4 + length - 4)[0]
    return {"offset": offset, "variants": variants, "samples": samples, "compression": flags & 3, "layout": flags >> 2 & 15, "sample_ids": flags >> 31}


def read_npy(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """(row, values) of a two-dimensional NPY file that executors can open; partitions are ranges of rows."""
    shape = np.load(path, mmap_mode="r").shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.load(path, mmap_mode="r")
        for batch in batches:
            for lo in batch.column(0).to_pylist():
                own = np.asarray(matrix[lo : lo + rows], np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * own.shape[1]), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(own))), lists], ["row", "values"])

    return spark.range(0, shape[0], rows).mapInArrow(run, "row bigint, values array<double>")

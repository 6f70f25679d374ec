"""Fingerprints of files of any size, read in pieces: their whole digest, or size with head and tail.

The listing reads no content. Files are dealt to tasks one by one, and a task
holds one piece of a file at a time, so a file over the two gigabytes that a
binary column can hold is read like any other. Paths must be ones that
executors can open. The same rule is there for content in a column.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship

#: Bytes of a piece; of the head and the tail; of the largest file that is digested whole.
PIECE, WINDOW, WHOLE = 1 << 20, 64 << 20, 2 << 30
FULL, ENDS = "sha256_full", "sha256_head_tail_size"
SCHEMA = "path string, bytes bigint, algorithm string, value string, covers_whole_file boolean, error string"


def pieces(path: str, start: int, length: int) -> Iterator[bytes]:
    with open(path, "rb") as f:
        f.seek(start)
        while length > 0:
            piece = f.read(min(PIECE, length))
            if not piece:
                return
            length -= len(piece)
            yield piece


def fingerprint(path: str, size: int, whole: int = WHOLE, window: int = WINDOW) -> tuple[str, str, bool]:
    """Algorithm, hex digest, and whether it covers all bytes. Beyond `whole` bytes: of the size as text, the head, and the tail behind it."""
    digest, full = hashlib.sha256(), size <= whole
    spans = [(0, size)] if full else [(0, min(window, size)), (max(size - window, window), size)]
    if not full:
        digest.update(str(size).encode())
    for start, stop in spans:
        for piece in pieces(path, start, stop - start):
            digest.update(piece)
    return FULL if full else ENDS, digest.hexdigest(), full


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path and bytes of each file below root; contents are not read. Spark gives no row for an empty file, so these are added from its list of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    sized = files.select("path", F.col("length").alias("bytes"))
    names = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string")
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    empty = names.select(plain.alias("path")).join(sized.select(plain.alias("path")), "path", "left_anti")
    return sized.unionByName(empty.withColumn("bytes", F.lit(0).cast("bigint")))


def fingerprints(spark: SparkSession, root: str, whole: int = WHOLE, window: int = WINDOW) -> DataFrame:
    """path, bytes, algorithm, value, covers_whole_file of each file below root; error for one that changed or cannot be read."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = "/" + path.removeprefix("file:").lstrip("/")
                algorithm = value = error = None
                full = False
                try:
                    if os.path.getsize(own) != size:
                        raise ValueError("its size changed")
                    algorithm, value, full = fingerprint(own, size, whole, window)
                except (OSError, ValueError) as failure:
                    error = str(failure)
                yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "algorithm": algorithm, "value": value, "covers_whole_file": full, "error": error}], schema=_ARROW)

    # every file is a row of its own task's queue, large ones not behind each other by name
    return listed(spark, root).repartition(F.xxhash64("path")).mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("algorithm", pa.string()), ("value", pa.string()), ("covers_whole_file", pa.bool_()), ("error", pa.string())])


def content_fingerprint(content: Column, whole: int, window: int) -> tuple[Column, Column]:
    """Algorithm and digest of bytes in a column by the same rule, with built-in functions."""
    size = F.octet_length(content)
    tail = F.greatest(size - window, F.lit(window))
    ends = F.concat(F.encode(size.cast("string"), "utf-8"), F.substring(content, F.lit(1), F.lit(window)), F.substring(content, tail + 1, F.greatest(size - tail, F.lit(0))))
    full = size <= whole
    return F.when(full, FULL).otherwise(ENDS), F.when(full, F.sha2(content, 256)).otherwise(F.sha2(ends, 256))

"""Writers: tables, documents, digests and published folders."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, order: list[str] | None = None, gzip: bool = False) -> None:
    """One text table with a header; refuses to overwrite. For results that fit one file."""
    out = df.coalesce(1).sortWithinPartitions(*order) if order else df.coalesce(1)
    writer = out.write.mode("errorifexists").option("sep", "\t").option("header", True)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; refuses to overwrite."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def summary_document(row: DataFrame) -> str:
    """A one-row aggregate as an indented JSON document with sorted keys."""
    import json

    return json.dumps(json.loads(row.select(F.to_json(F.struct("*"))).first()[0]), indent=2, sort_keys=True)


def digests(spark: SparkSession, root: str) -> DataFrame:
    """name below root, bytes and SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    return files.select(F.expr("substring(path, {})".format(len(full) + 1)).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose digest differs or that only one side has."""
    joined = before.alias("b").join(after.alias("a"), F.col("a.name") == F.col("b.name"), "full")
    return joined.where(~F.col("a.sha256").eqNullSafe(F.col("b.sha256"))).select(F.coalesce("a.name", "b.name").alias("name"), F.when(F.col("a.name").isNull(), "gone").when(F.col("b.name").isNull(), "new").otherwise("differs").alias("change"))


def tree_digest(files: DataFrame) -> str:
    """One digest of a folder: of the sorted lines of names and file digests."""
    lines = [f"{r['name']}  {r['sha256']}" for r in files.select("name", "sha256").orderBy("name").toLocalIterator()]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def published(spark: SparkSession, path: str, build: Callable[[str], None], check: Callable[[str], None] = lambda p: None) -> str:
    """Build beside path, check, then rename into place; a failure leaves nothing at path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    work, end = hadoop.Path(f"{path}.{uuid.uuid4().hex}"), hadoop.Path(path)
    fs = end.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(end):
        raise FileExistsError(path)
    try:
        build(work.toString())
        check(work.toString())
        if not fs.rename(work, end):
            raise OSError(f"cannot rename to {path}")
    finally:
        fs.delete(work, True)
    return path


def bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Several tables published together, with the digests of their files."""

    def build(work: str) -> None:
        for name, df in tables.items():
            write_tsv(df, f"{work}/{name}")

    published(spark, path, build)
    return digests(spark, path)

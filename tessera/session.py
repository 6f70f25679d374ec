"""Session access and shared scratch tables."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir, as in tests on one machine.
OWN_SCRATCH = "/tmp/tessera-scratch"


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[[^,]*(,\s*\d+)?\])?$", spark.sparkContext.master):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{OWN_SCRATCH}-{os.getuid()}"


def mounted_scratch(spark: SparkSession) -> str | None:
    """The shared folder as a path that Python can open, if it is one: made if need be."""
    named = scratch_dir(spark)
    if named.startswith("file:"):
        named = "/" + named[5:].lstrip("/")
    if not named.startswith("/"):
        return None
    Path(named).mkdir(parents=True, exist_ok=True)
    return named


#: Paths of the tables that keep() has written and forget() has not removed.
kept_paths: list[str] = []


#: Where the tables that this thread keeps are noted besides, while it collects them.
_collecting: ContextVar[list[str] | None] = ContextVar("collecting", default=None)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The paths of the tables that this thread keeps meanwhile; those of other threads are not among them."""
    paths: list[str] = []
    before = _collecting.set(paths)
    try:
        yield paths
    finally:
        _collecting.reset(before)


@atexit.register
def _forget_mounted() -> None:
    """At the end of the driver, remove the kept tables that are still there, where their folder is mounted."""
    for path in kept_paths:
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Remove kept tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in kept_paths:
            kept_paths.remove(path)


def keep(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs no more than rereading the files.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept_paths.append(path)
    if (collecting := _collecting.get()) is not None:
        collecting.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one, for files that Python opens; it goes with the driver."""
    root = mounted_scratch(spark)
    if root is None:
        raise RuntimeError(f"{scratch_dir(spark)} is no path that Python can open")
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    kept_paths.append(path)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, for drivers whose path they do not share."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_package.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(packed))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Matrices written by many tasks into one file: NPY, PGEN or PLINK hardcalls.

Rows have fixed sizes, so each has its place. The driver lays out a scratch
file of the full size beside the target; every task writes its rows at their
offsets, in runs, and reports the runs. Only if these cover each row once is
the scratch file renamed into place; otherwise, and when a task fails for good,
it is removed. A task that runs twice writes the same bytes to the same place.
The folder must be one that driver and executors share and can open.

Calls of few samples a variant are written without a value for every other
sample in memory: as PGEN records of the size that each needs, whose places are
running sums of these sizes, or packed into the two bits a sample of a BED row.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessera.operators.numbering import running
from tessera.session import keep
from tessera.sources import pgen
from tessera.sources.genotypes import ALL_MISSING, CHUNK, COPIES, MAGIC
from tessera.sources.pgen import FIXED, PGEN_MAGIC, VARIABLE

#: Two-bit codes of dosages 0, 1, 2 and missing, by format.
CODES = {"pgen": np.array([0, 1, 2, 3], np.uint8), "bed": np.array([COPIES.index(d) for d in (0, 1, 2, -1)], np.uint8)}


def header(kind: str, rows: int, width: int, dtype: str) -> bytes:
    if kind == "npy":
        out = io.BytesIO()
        np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(np.dtype(dtype)), "fortran_order": False, "shape": (rows, width)})
        return out.getvalue()
    if kind == "pgen":
        return PGEN_MAGIC + bytes([FIXED]) + rows.to_bytes(4, "little") + width.to_bytes(4, "little") + bytes([0x40])
    if kind == "pgen-records":  # types of one byte each, then lengths
        return PGEN_MAGIC + bytes([VARIABLE]) + rows.to_bytes(4, "little") + width.to_bytes(4, "little") + bytes([0x40 + 4 + length_bytes(width) - 1])
    if kind == "bed":
        return MAGIC
    raise ValueError(f"no matrix format {kind}")


def length_bytes(width: int) -> int:
    """Bytes of a PGEN record's length; no record that encoded_calls makes is longer than plain codes."""
    return max(1, (int(-(-width // 4)).bit_length() + 7) // 8)


def row_bytes(kind: str, width: int, dtype: str) -> int:
    if kind == "pgen-records":
        return 1 + length_bytes(width)
    return width * np.dtype(dtype).itemsize if kind == "npy" else -(-width // 4)


def encoded(kind: str, values: np.ndarray, dtype: str) -> np.ndarray:
    """Rows of bytes. Dosages that are null, not finite or negative are missing."""
    if kind == "npy":
        return np.ascontiguousarray(values.astype(dtype)).view(np.uint8).reshape(len(values), -1)
    dosage = np.where(np.isfinite(values) & (values >= 0), values, 3)
    if not np.isin(dosage, (0, 1, 2, 3)).all():
        raise ValueError("a dosage is not 0, 1 or 2")
    codes = CODES[kind][dosage.astype(np.int64)]
    padded = np.zeros((len(codes), -(-codes.shape[1] // 4) * 4), np.uint8)
    padded[:, : codes.shape[1]] = codes
    return (padded.reshape(len(codes), -1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2, dtype=np.uint8)


@dataclass
class Runs(WriterCommitMessage):
    """First row and number of rows of each run that a task wrote."""

    runs: list[tuple[int, int]]


def uncovered(runs: list[tuple[int, int]], rows: int) -> str:
    """Why the runs are not each row once, or nothing."""
    at = 0
    for first, n in sorted(runs):
        if first != at:
            return f"row {first} is there twice" if first < at else f"row {at} is missing"
        at += n
    return "" if at == rows else (f"row {at} is missing" if at < rows else f"row {rows} is beyond the matrix")


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.kind, self.dtype = options["path"], options["kind"], options.get("dtype", "<f8")
        self.rows, self.width, self.overwrite = int(options["rows"]), int(options["width"]), overwrite
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        self.scratch = f"{self.path}.{uuid.uuid4().hex}.scratch"
        self.head, self.stride = header(self.kind, self.rows, self.width, self.dtype), row_bytes(self.kind, self.width, self.dtype)
        with open(self.scratch, "wb") as f:
            f.write(self.head)
            f.truncate(len(self.head) + self.rows * self.stride)

    def _placed(self, batch: pa.RecordBatch) -> np.ndarray:
        at = batch.column(0).to_numpy(zero_copy_only=False)
        if len(at) and (at.min() < 0 or at.max() >= self.rows):
            raise ValueError("a row lies outside the matrix")
        return at

    def _packed(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers, and the rows' bytes."""
        lists = batch.column(1)
        if lists.null_count or (np.diff(lists.offsets.to_numpy()) != self.width).any():
            raise ValueError(f"a row has not {self.width} values")
        at = self._placed(batch)
        yield at, encoded(self.kind, lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), self.width), self.dtype)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Runs:
        runs: list[tuple[int, int]] = []
        file = os.open(self.scratch, os.O_WRONLY)
        try:
            for batch in iterator:
                for at, raw in self._packed(batch):
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]]) if len(at) else np.zeros(1, int)
                    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        data, place = memoryview(raw[lo:hi].tobytes()), len(self.head) + int(at[lo]) * self.stride
                        while len(data):
                            done = os.pwrite(file, data, place)
                            data, place = data[done:], place + done
                        if runs and sum(runs[-1]) == at[lo]:
                            runs[-1] = (runs[-1][0], runs[-1][1] + hi - lo)
                        else:
                            runs.append((int(at[lo]), hi - lo))
            os.fsync(file)
        finally:
            os.close(file)
        return Runs(runs)

    def commit(self, messages: list[Runs | None]) -> None:
        wrong = uncovered([run for m in messages if m is not None for run in m.runs], self.rows)
        if wrong:
            os.unlink(self.scratch)
            raise ValueError(wrong)
        if self.overwrite:
            os.replace(self.scratch, self.path)
            return
        try:
            os.link(self.scratch, self.path)  # fails if another job was first
        finally:
            os.unlink(self.scratch)

    def abort(self, messages: list[Runs | None]) -> None:
        if os.path.exists(self.scratch):
            os.unlink(self.scratch)


def _listed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, places, dosages): where the rows' lists end, from 0 on, and what they hold."""
    who, what = batch.column(1), batch.column(2)
    ends = who.offsets.to_numpy() - who.offsets[0].as_py()
    if who.null_count or what.null_count or (np.diff(what.offsets.to_numpy()) != np.diff(ends)).any():
        raise ValueError("places and dosages of a row differ in number")
    return ends, who.flatten().to_numpy(zero_copy_only=False).astype(np.int64), what.flatten().to_numpy(zero_copy_only=False)


class CalledBedWriter(MatrixWriter):
    """(row, places, dosages): calls packed into two bits a sample, some rows at a time."""

    def _packed(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, (ends, places, dosages) = self._placed(batch), _listed(batch)
        if len(places) and (places.min() < 0 or places.max() >= self.width or dosages.min() < 0 or dosages.max() > 2):
            raise ValueError("calls are outside the samples, or not 0, 1 or 2")
        row, shift = np.repeat(np.arange(len(at)), np.diff(ends)), (places % 4 * 2).astype(np.uint8)
        turned = (CODES["bed"][dosages] ^ CODES["bed"][3]) << shift  # from missing to the call
        most = max(1, CHUNK // max(1, self.stride))
        for lo in range(0, len(at), most):
            hi = min(lo + most, len(at))
            raw = np.full((hi - lo, self.stride), ALL_MISSING, np.uint8)
            if self.width % 4:
                raw[:, -1] &= (1 << self.width % 4 * 2) - 1
            own = slice(int(ends[lo]), int(ends[hi]))
            np.bitwise_xor.at(raw, (row[own] - lo, places[own] // 4), turned[own])
            yield at[lo:hi], raw


class CalledBedSink(DataSource):
    """df.write.format("bed_called") of (row, places, dosages), with options rows and width."""

    @classmethod
    def name(cls) -> str:
        return "bed_called"

    def schema(self) -> str:
        return "row bigint, places array<int>, dosages array<tinyint>"

    def writer(self, schema, overwrite: bool) -> CalledBedWriter:
        return CalledBedWriter({**self.options, "kind": "bed"}, overwrite)


def write_called_bed(calls: DataFrame, path: str, rows: int, width: int) -> None:
    """(row, places, dosages), one row a variant, as a PLINK matrix: dosages 0, 1 or 2 of the samples at these places; the others are missing.

    The format takes two bits a sample of each variant; no task holds more than some rows of it.
    """
    spark = calls.sparkSession
    spark.dataSource.register(CalledBedSink)
    from pyspark.sql import functions as F

    placed = keep(calls.select(F.col("row").cast("bigint"), F.col("places").cast("array<int>"), F.col("dosages").cast("array<tinyint>")), "calls")
    placed.repartitionByRange("row").sortWithinPartitions("row").write.format("bed_called").options(rows=rows, width=width).mode("append").save(path)


class PgenWriter(MatrixWriter):
    """(row, before, kind, record): PGEN records of any size, before being the bytes of all records of earlier rows."""

    def __init__(self, options: dict, overwrite: bool):
        super().__init__({**options, "kind": "pgen-records"}, overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Runs:
        runs: list[tuple[int, int]] = []
        size, blocks = self.stride - 1, -(-self.rows // pgen.BLOCK)
        table = len(self.head) + 8 * blocks
        begin = table + self.stride * self.rows
        file = os.open(self.scratch, os.O_WRONLY)

        def put(data: bytes, place: int) -> None:
            left = memoryview(data)
            while len(left):
                done = os.pwrite(file, left, place)
                left, place = left[done:], place + done

        try:
            for batch in iterator:
                at, records = self._placed(batch), batch.column(3).to_pylist()
                before, kinds = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                lengths = np.array([len(r) for r in records], "<i8")
                # a run ends with its block, whose records' types and lengths stand together
                cuts = np.concatenate([[0], np.flatnonzero((np.diff(at) != 1) | (at[1:] % pgen.BLOCK == 0)) + 1, [len(at)]]) if len(at) else np.zeros(1, int)
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if (np.diff(before[lo:hi]) != lengths[lo : hi - 1]).any():
                        raise ValueError(f"records from row {at[lo]} on do not follow one another")
                    block, first = divmod(int(at[lo]), pgen.BLOCK)
                    inside = min(pgen.BLOCK, self.rows - block * pgen.BLOCK)
                    body = table + block * pgen.BLOCK * self.stride
                    put(kinds[lo:hi].astype(np.uint8).tobytes(), body + first)
                    put(lengths[lo:hi].view(np.uint8).reshape(-1, 8)[:, :size].tobytes(), body + inside + first * size)
                    if first == 0:
                        put((begin + int(before[lo])).to_bytes(8, "little"), len(self.head) + 8 * block)
                    put(b"".join(records[lo:hi]), begin + int(before[lo]))
                    runs.append((int(at[lo]), hi - lo))
            os.fsync(file)
        finally:
            os.close(file)
        return Runs(runs)


class PgenSink(DataSource):
    """df.write.format("pgen_records") of (row, before, kind, record), with options rows and width."""

    @classmethod
    def name(cls) -> str:
        return "pgen_records"

    def schema(self) -> str:
        return "row bigint, before bigint, kind tinyint, record binary"

    def writer(self, schema, overwrite: bool) -> PgenWriter:
        return PgenWriter(self.options, overwrite)


def write_called_pgen(calls: DataFrame, path: str, rows: int, width: int) -> None:
    """(row, places, dosages), one row a variant, as a PGEN file: dosages 0, 1 or 2 of the samples at ascending places; the others are missing."""
    spark = calls.sparkSession
    spark.dataSource.register(PgenSink)
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, places, dosages = _listed(batch)
            made = [pgen.encoded_calls(places[a:b], dosages[a:b], width) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in made], pa.int8()), pa.array([r for _, r in made], pa.binary())], ["row", "kind", "record"])

    records = calls.select(F.col("row").cast("bigint"), F.col("places").cast("array<int>"), F.col("dosages").cast("array<tinyint>")).mapInArrow(run, "row bigint, kind tinyint, record binary")
    placed = running(keep(records, "records"), "upto", F.octet_length("record"), "row").select("row", (F.col("upto") - F.octet_length("record")).alias("before"), "kind", "record")
    placed.repartitionByRange("row").sortWithinPartitions("row").write.format("pgen_records").options(rows=rows, width=width).mode("append").save(path)


class MatrixSink(DataSource):
    """df.write.format("matrix") of (row, values), with options kind, rows, width and dtype."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "row bigint, values array<double>"

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options, overwrite)


def write_matrix(df: DataFrame, path: str, kind: str, rows: int, width: int, row_col: str = "row", values_col: str = "values", dtype: str = "<f8", overwrite: bool = False) -> None:
    """df's rows, each with its number and all of its values, as one file. Rows are dealt in ranges, so that tasks write long runs."""
    spark = df.sparkSession
    spark.dataSource.register(MatrixSink)
    from pyspark.sql import functions as F

    placed = df.select(F.col(f"`{row_col}`").cast("bigint").alias("row"), F.col(f"`{values_col}`").cast("array<double>").alias("values"))
    ordered = placed.repartitionByRange("row").sortWithinPartitions("row")
    ordered.write.format("matrix").options(kind=kind, rows=rows, width=width, dtype=dtype).mode("overwrite" if overwrite else "append").save(path)

"""The leading subspace of a table of vectors, by randomised subspace iteration.

A pass over the rows multiplies their covariance with a few vectors: each task
multiplies its own rows, first with the vectors and then, transposed, with the
result, and reduces the first product by QR to a small triangle. Sums and
triangles are combined over a tree of tasks, sixteen at a time; only the last
ones, of columns x vectors and vectors x vectors, reach the driver. The
triangle's singular vectors turn the vectors to the leading directions, and the
passes end once these stand still. Tables with at most twice as many columns
as vectors take one pass with a vector a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import keep, ship

FAN = 16
PARTS = "part int, numbers array<double>"


@dataclass
class Subspace:
    mean: np.ndarray
    #: Orthonormal columns, that of the largest value first.
    basis: np.ndarray
    #: Variances along them.
    values: np.ndarray
    rows: int
    passes: int


def _stacked(batch: pa.RecordBatch, column: int) -> np.ndarray:
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def reduced(rows: DataFrame, start: Callable[[], object], add: Callable, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """One array from all rows: add(state, batch) folds a task's batches to an array, combine joins two of them, over a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = start()
        for batch in batches:
            if batch.num_rows:
                state = add(state, batch)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([state])], ["part", "numbers"])

    def join(group: pa.Table) -> pa.Table:
        order = group.sort_by("part")
        out = None
        for numbers in order.column("numbers"):
            one = np.array(numbers.as_py())
            out = one if out is None else combine(out, one)
        return pa.table({"part": pa.array([order.column("part")[0].as_py() // FAN], pa.int32()), "numbers": pa.array([out])})

    parts, width = rows.mapInArrow(run, PARTS), rows.rdd.getNumPartitions()
    while width > FAN:
        parts, width = parts.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(lambda t: join(t), PARTS), -(-width // FAN)
    last = [np.array(r["numbers"]) for r in parts.orderBy("part").collect()]  # at most FAN
    out = None
    for one in last:
        out = one if out is None else combine(out, one)
    return out


def triangle(tall: np.ndarray) -> np.ndarray:
    """R of a tall matrix, square however few rows there are."""
    k = tall.shape[1]
    r = np.linalg.qr(tall, mode="r")
    return np.concatenate([r, np.zeros((k - len(r), k))]) if len(r) < k else r


def mean_of(rows: DataFrame) -> tuple[int, np.ndarray]:
    def add(state, batch):
        x = _stacked(batch, 0)
        own = np.concatenate([[len(x)], x.sum(axis=0)])
        return own if state is None else state + own

    total = reduced(rows, lambda: None, add, np.add)
    if total is None:
        raise ValueError("no rows")
    return int(total[0]), total[1:] / total[0]


def multiplied(rows: DataFrame, mean: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centred rows' scatter times the vectors, and the triangle of the rows times the vectors."""
    d, k = vectors.shape
    sent = rows.sparkSession.sparkContext.broadcast((mean, vectors))

    def add(state, batch):
        own_mean, own = sent.value
        x = _stacked(batch, 0) - own_mean
        y = x @ own
        numbers = np.concatenate([(x.T @ y).ravel(), triangle(y).ravel()])
        return numbers if state is None else combine(state, numbers)

    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        cut = d * k
        both = np.concatenate([a[cut:].reshape(k, k), b[cut:].reshape(k, k)])
        return np.concatenate([a[:cut] + b[:cut], triangle(both).ravel()])

    out = reduced(rows, lambda: None, add, combine)
    sent.destroy()
    return out[: d * k].reshape(d, k), out[d * k :].reshape(k, k)


def principal_angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Angles between two subspaces of orthonormal columns, in radians, smallest first; small ones by their sines."""
    sines = np.linalg.svd(right - left @ (left.T @ right), compute_uv=False)[::-1]
    cosines = np.linalg.svd(left.T @ right, compute_uv=False)
    return np.where(cosines > 0.7, np.arcsin(np.clip(sines, 0, 1)), np.arccos(np.clip(cosines, -1, 1)))


def leading_subspace(table: DataFrame, vector_col: str, rank: int, oversample: int = 8, tolerance: float = 1e-9, most: int = 1000, seed: int = 0) -> Subspace:
    """The directions of most variance of the vectors that are not null, all of one length.

    Ends when a pass turns the leading directions by less than tolerance; raises if that takes more than `most` passes.
    """
    ship(table.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    rows = keep(table.where(F.col(vector_col).isNotNull()).select(v.alias("v")), "vectors")
    widths = [r[0] for r in rows.select(F.size("v")).distinct().limit(2).collect()]
    if len(widths) != 1:
        raise ValueError(f"vectors of {len(widths)} lengths")
    d = widths[0]
    n, mean = mean_of(rows)
    k = rank + oversample
    k = d if d <= 2 * k else k  # with as many vectors as columns the first pass is exact, and costs no more than two with half as many
    rank = min(rank, k)
    vectors = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, k)))[0]
    before = None
    for passes in range(1, most + 1):
        product, r = multiplied(rows, mean, vectors)
        _, s, turned = np.linalg.svd(r)
        leading = vectors @ turned[:rank].T
        if k == d or (before is not None and principal_angles(before, leading).max(initial=0) < tolerance):
            return Subspace(mean, leading, s[:rank] ** 2 / max(1, n - 1), n, passes)
        before, vectors = leading, np.linalg.qr(product)[0]
    raise ValueError(f"the subspace still turns after {most} passes")


def energies(table: DataFrame, id_col: str, vector_col: str, space: Subspace) -> DataFrame:
    """(id, inside, outside): the squared length of each centred vector in the subspace and across it, the same for any basis of it."""
    sent = table.sparkSession.sparkContext.broadcast((space.mean, space.basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, basis = sent.value
        for batch in batches:
            if batch.num_rows:
                x = _stacked(batch, 1) - mean
                y = x @ basis
                inside = (y**2).sum(axis=1)
                outside = ((x - y @ basis.T) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(inside), pa.array(outside)], ["id", "inside", "outside"])

    rows = table.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id bigint, inside double, outside double")

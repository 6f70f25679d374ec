"""Leading axes of a Gaussian kernel over rows too many for their kernel matrix.

A group's rows are packed in blocks. A task gets two blocks at a time, makes the
kernel between them a few hundred rows at a time and keeps none of it, so the
kernel's memory is that of a chunk however large the group is; the work stays
training rows x rows. The width, a median over all pairs, is found by counting
distances in ever finer bins of their bits. The axes come from subspace
iteration: each pass multiplies the kernel with some vectors, tasks reduce the
products to triangles, and the passes end once the axes solve the eigenvalue
problem. Groups of at most `small` rows go through one task each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.regression import kernel_axes, squared_distances
from tessera.operators.subspace import FAN, triangle
from tessera.session import collected, forget, keep

#: Least and most rows a block; rows of one block and of another whose kernel is held at once, so that it stays in a core's cache.
NARROW, WIDE, CHUNK, ACROSS = 1024, 16_384, 256, 512
#: Bins of one counting, and values that are counted one by one.
BINS_BITS, SINGLE = 14, 1 << 18
#: Vectors beyond the rows' own directions, and the most of those.
SPARE, DIRECTIONS = 16, 64
TOLERANCE, MOST_PASSES = 1e-10, 300


def kernel_scores(rows: DataFrame, group: str, id_col: str, vector: str, place: str, train: str, k: int, small: int = 4096, width: int | None = None, most: int = 1000) -> DataFrame:
    """(group, id, k1..kk): scores of all rows on the k leading axes of their group's Gaussian kernel over the rows where train is true.

    The kernel's width is the median of the positive squared distances between training rows; axes with an eigenvalue of 1e-10 or
    less score zero, and so does every row of a group without training rows. place numbers a group's rows and fixes the blocks.
    Vectors are of one length, those that are null take no part. An axis' sign is open; in groups of more than `small` rows its
    largest loading is positive. Raises if more than `most` groups are that large, or if an axis does not settle.
    """
    kinds, spark = dict(rows.dtypes), rows.sparkSession
    names = [f"k{i + 1}" for i in range(k)]
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("key")
    own = rows.where(F.col(vector).isNotNull()).select(key, F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x"), F.col(place).cast("bigint").alias("place"), F.coalesce(train, F.lit(False)).alias("train"))
    own = keep(own, "kernel-rows")
    sizes = own.groupBy("key").agg(F.count("*").alias("n"))
    large = {r["key"]: r["n"] for r in sizes.where(F.col("n") > small).limit(most + 1).collect()}
    if len(large) > most:
        raise ValueError(f"more than {most} groups of over {small} rows")
    schema = f"g {kinds[group]}, id {kinds[id_col]}, " + ", ".join(f"{n} double" for n in names)

    def direct(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        x, scores = np.vstack(frame["x"].to_list()), np.zeros((len(frame), k))
        if frame["train"].any():
            found = kernel_axes(x, x[frame["train"].to_numpy(bool)], k)
            scores[:, : found.shape[1]] = found
        return frame[["g", "id"]].assign(**{n: scores[:, i] for i, n in enumerate(names)})

    few = own.where(~F.col("key").isin(*large)) if large else own
    out = few.groupBy("key").applyInPandas(direct, schema)
    if large:
        # each block goes to tasks with all blocks of its group, so large groups have few
        width = width or min(WIDE, max(NARROW, max(large.values()) // 12))
        out = out.unionByName(_Blocks(own.where(F.col("key").isin(*large)), kinds[group], kinds[id_col], width).scores(k, schema))
    return out.withColumnsRenamed({"g": group, "id": id_col})


def _numbers(value: pa.Scalar, rows: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=np.float64).reshape(rows, -1)


def _packed(table: pa.Table) -> pa.Table:
    table = table.sort_by("place").combine_chunks()
    lists = table.column("x").combine_chunks()
    if len(set(np.diff(lists.offsets.to_numpy()).tolist())) != 1:
        raise ValueError("vectors of several lengths")
    x = lists.flatten().to_numpy(zero_copy_only=False)
    one = [table.column(c).slice(0, 1).combine_chunks() for c in ("key", "g", "train", "b")]
    ids = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column("id").combine_chunks())
    return pa.table([*one, ids, pa.array([len(table)], pa.int32()), pa.array([x.tobytes()])], ["key", "g", "train", "b", "ids", "n", "x"])


def _added(table: pa.Table) -> pa.Table:
    """The sum of the products of one block, in the order of the blocks that they are with."""
    table = table.sort_by("c")
    total = sum(np.frombuffer(y.as_buffer()) for y in table.column("y"))
    head = {c: table.column(c).slice(0, 1) for c in ("key", "b")}
    return pa.table({**head, "c": pa.array([table.column("c")[0].as_py() // FAN], pa.int32()), "y": pa.array([total.tobytes()])})


def _stacked_triangles(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    out = None
    for r in table.column("r"):
        one = np.frombuffer(r.as_buffer())
        one = one.reshape(int(len(one) ** 0.5), -1)
        out = one if out is None else triangle(np.concatenate([out, one]))
    return pa.table({"key": table.column("key").slice(0, 1), "part": pa.array([table.column("part")[0].as_py() // FAN], pa.int32()), "r": pa.array([out.tobytes()])})


class _Blocks:
    """The blocks of some large groups."""

    def __init__(self, rows: DataFrame, group_kind: str, id_kind: str, width: int):
        self.spark = rows.sparkSession
        dealt = rows.withColumn("b", F.floor(F.col("place") / width).cast("int"))
        schema = f"key string, g {group_kind}, train boolean, b int, ids array<{id_kind}>, n int, x binary"
        # keyed by the block alone, so that small tables are dealt over all cores too
        self.all = keep(dealt.groupBy("key", "train", "b").applyInArrow(lambda t: _packed(t), schema), "kernel-blocks")
        self.train: dict[str, list[int]] = {}
        self.other: dict[str, list[int]] = {}
        for r in self.all.groupBy("key", "train").agg(F.sort_array(F.collect_list("b")).alias("b")).collect():
            (self.train if r["train"] else self.other)[r["key"]] = r["b"]

    def blocks(self, train: bool) -> DataFrame:
        return self.all.where(F.col("train") if train else ~F.col("train"))

    def listed(self, lists: dict[str, list[int]], name: str) -> DataFrame:
        rows = [(k, b) for k, b in lists.items()]
        return F.broadcast(self.spark.createDataFrame(rows, f"key string, {name} array<int>"))

    def dealt(self, rows: DataFrame, pairs: int) -> DataFrame:
        return rows.repartition(max(1, min(pairs, 2000)), "key", "i", "j").groupBy("key", "i", "j")

    def pairs(self, blocks: DataFrame, groups: list[str], *columns: str):
        """Training blocks with one another, each two of a group once, and each with itself."""
        lists = {g: self.train[g] for g in groups}
        met = blocks.join(self.listed(lists, "with"), "key").select("*", F.explode("with").alias("c"))
        return self.dealt(met.select("key", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), "b", "n", *columns), sum(len(b) * (len(b) + 1) // 2 for b in lists.values()))

    def summed(self, parts: DataFrame, most: int) -> DataFrame:
        """(key, b, y) from (key, b, c, y): products added over c, sixteen at a time."""
        schema = "key string, b int, c int, y binary"
        parts = parts.withColumn("c", F.col("c").cast("int"))
        while True:
            parts = parts.groupBy("key", "b", F.floor(F.col("c") / FAN).alias("of")).applyInArrow(lambda t: _added(t), schema)
            if most < FAN:
                return parts.drop("c")
            most //= FAN

    def medians(self) -> dict[str, float]:
        """Each group's median of the positive squared distances of its training rows, exact; 1 without any."""
        wanted = {(g, t): {"low": 1, "high": 0x7FF0 << 48, "shift": 63 - BINS_BITS, "rank": None} for g in self.train for t in (0, 1)}
        found: dict[tuple[str, int], float] = {}
        while wanted:
            groups = sorted({g for g, _ in wanted})
            asked: dict[str, dict[tuple[int, int, int], list[int]]] = {}
            for (g, t), w in wanted.items():
                asked.setdefault(g, {}).setdefault((w["low"], w["high"], w["shift"]), []).append(t)
            counted = self.pairs(self.blocks(True), groups, "x").applyInArrow(_counting(asked), "key string, t int, bin bigint, n bigint")
            counted = counted.groupBy("key", "t", "bin").agg(F.sum("n").alias("n"))
            ranks = self.spark.createDataFrame([(g, t, w["rank"]) for (g, t), w in wanted.items()], "key string, t int, rank bigint")
            whole = "PARTITION BY key, t"
            placed = counted.join(F.broadcast(ranks), ["key", "t"]).select("*", F.expr(f"sum(n) OVER ({whole} ORDER BY bin)").alias("upto"), F.expr(f"sum(n) OVER ({whole})").alias("total"))
            placed = placed.withColumn("rank", F.expr("coalesce(rank, (total - 1 + t) div 2)"))
            chosen = {(r["key"], r["t"]): r for r in placed.where("upto > rank and upto - n <= rank").collect()}
            for at in list(wanted):
                if at not in chosen:  # no positive distance
                    found[at] = 1.0
                    del wanted[at]
                    continue
                w, r = wanted[at], chosen[at]
                if w["shift"] == 0:
                    found[at] = float(np.array([w["low"] + r["bin"]], np.int64).view(np.float64)[0])
                    del wanted[at]
                    continue
                low = w["low"] + (r["bin"] << w["shift"])
                shift = 0 if r["n"] <= SINGLE else max(0, w["shift"] - BINS_BITS)
                wanted[at] = {"low": low, "high": low + (1 << w["shift"]), "shift": shift, "rank": r["rank"]}
        return {g: (found[g, 0] + found[g, 1]) / 2 for g in self.train}

    def triangles(self, table: DataFrame, columns: Callable, groups: list[str]) -> dict[str, np.ndarray]:
        """By group, the triangle of a column of ones and columns(row) over all rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    own = columns(row)
                    r = triangle(np.concatenate([np.ones((len(own), 1)), own], axis=1))
                    yield pa.RecordBatch.from_arrays([pa.array([row["key"]]), pa.array([row["b"]], pa.int32()), pa.array([r.tobytes()])], ["key", "part", "r"])

        schema = "key string, part int, r binary"
        parts, most = table.mapInArrow(run, schema), max(b[-1] for b in self.train.values())
        while most > 0:
            parts, most = parts.groupBy("key", F.floor(F.col("part") / FAN).alias("of")).applyInArrow(lambda t: _stacked_triangles(t), schema), most // FAN
        out = {r["key"]: np.frombuffer(bytes(r["r"])) for r in parts.collect()}
        return {g: out[g].reshape(int(len(out[g]) ** 0.5), -1) for g in groups}

    def scores(self, k: int, schema: str) -> DataFrame:
        groups = sorted(self.train)
        names = [f"k{i + 1}" for i in range(k)]
        alone = self.blocks(False).where(~F.col("key").isin(groups)) if groups else self.blocks(False)
        out = alone.select("g", F.explode("ids").alias("id"), *[F.lit(0.0).alias(n) for n in names])
        if not groups:
            return out
        gamma = {g: 1 / m for g, m in self.medians().items()}
        train = self.blocks(True).select("key", "g", "b", "ids", "n", "x")
        maps = {g: _orthonormal(r[1:, 1:], r[0, 1:] / r[0, 0]) for g, r in self.triangles(train, _start, groups).items()}
        state, start, done, spent = train, True, [], []
        for _ in range(MOST_PASSES):
            with collected() as vectors:
                turned = keep(_mapped(state.where(F.col("key").isin(sorted(maps))).drop("v"), "v", maps, start), "kernel-vectors")
            forget(self.spark, spent)
            with collected() as spent:
                parts = self.pairs(turned, sorted(maps), "x", "v").applyInArrow(_multiplying(gamma), "key string, b int, c int, y binary")
                state = keep(turned.join(self.summed(parts, max(max(self.train[g]) for g in maps)), ["key", "b"]), "kernel-products")
            forget(self.spark, vectors)
            start, axes = False, {}
            settled = {g: _settled(r, k) for g, r in self.triangles(state, _both, sorted(maps)).items()}
            for g, (near, axis, score, again) in settled.items():
                if near:
                    axes[g] = (axis, score)
                    del maps[g]
                else:
                    maps[g] = again
            if axes:
                spent = []  # still read
                done.append(self.finished(state.where(F.col("key").isin(sorted(axes))), axes, gamma, k, schema))
            if not maps:
                break
        else:
            raise ValueError(f"the axes of {sorted(maps)} still move after {MOST_PASSES} passes")
        for one in done:
            out = out.unionByName(one)
        return out

    def finished(self, state: DataFrame, axes: dict, gamma: dict[str, float], k: int, schema: str) -> DataFrame:
        """Scores of all rows of groups whose axes are known, as maps of their training rows' vectors and products."""
        groups = sorted(axes)
        loads = _mapped(state.select("key", "b", "n", "x", F.col("v").alias("y")), "a", {g: a for g, (a, _) in axes.items()})
        loads = keep(loads, "kernel-axes")
        signs = dict.fromkeys(groups, np.ones(k))
        largest = loads.mapInArrow(_largest, "key string, b int, axis int, value double").groupBy("key", "axis").agg(F.max_by("value", F.struct(F.abs("value"), -F.col("b"))).alias("value"))
        for r in largest.collect():
            signs[r["key"]] = np.where((np.arange(k) == r["axis"]) & (r["value"] < 0), -1.0, signs[r["key"]])
        shared = {g: (score[0] * signs[g], score[1]) for g, (_, score) in axes.items()}
        own = _mapped(state.drop("v"), "s", shared).mapInArrow(_unpacked(k), schema)
        lists = {g: self.other[g] for g in groups if g in self.other}
        if not lists:
            return own
        others = self.blocks(False).where(F.col("key").isin(sorted(lists)))
        left = others.join(self.listed({g: self.train[g] for g in lists}, "with"), "key").select("key", F.col("b").alias("i"), F.explode("with").alias("j"), "train", "n", "x", F.lit(None).cast("binary").alias("a"))
        right = loads.join(self.listed(lists, "with"), "key").select("key", F.explode("with").alias("i"), F.col("b").alias("j"), F.lit(True).alias("train"), "n", "x", "a")
        met = self.dealt(left.unionByName(right), sum(len(b) * len(self.train[g]) for g, b in lists.items()))
        parts = met.applyInArrow(_crossing(gamma), "key string, b int, c int, y binary")
        summed = self.summed(parts, max(max(self.train[g]) for g in lists))
        # products with the axes are taken as they are, but for the training rows' mean of them
        flat = {g: (np.diag(signs[g]), axes[g][1][1] @ axes[g][1][0]) for g in lists}
        return own.unionByName(_mapped(others.select("key", "g", "b", "ids", "n", "x").join(summed, ["key", "b"]), "s", flat).mapInArrow(_unpacked(k), schema))


def _start(row: dict) -> np.ndarray:
    """The first vectors: a block's rows, or random directions of them, beside some noise drawn by the block's number."""
    x = np.frombuffer(row["x"]).reshape(row["n"], -1)
    if x.shape[1] > DIRECTIONS:
        x = x @ np.random.default_rng(0).normal(size=(x.shape[1], DIRECTIONS))
    size = max(1e-300, float(np.abs(x).max(initial=0)))
    return np.concatenate([x / size if np.isfinite(size) else x, np.random.default_rng([1, row["b"]]).normal(size=(len(x), SPARE))], axis=1)


def _both(row: dict) -> np.ndarray:
    return np.concatenate([np.frombuffer(row[c]).reshape(row["n"], -1) for c in ("v", "y")], axis=1)


def _orthonormal(tri: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map and the mean that turn columns of this triangle to orthonormal ones of mean zero, which span the same."""
    _, s, turned = np.linalg.svd(tri)
    some = s > 1e-9 * s[0]
    return turned[some].T / s[some], mean


def _settled(r: np.ndarray, k: int) -> tuple[bool, tuple, tuple, tuple]:
    """From the triangle of ones, vectors and products: whether the leading axes stand; maps to their loadings and to the training rows' scores; the map to the next vectors."""
    w = (r.shape[1] - 1) // 2
    own, product, means = r[1:, 1 : 1 + w], r[1:, 1 + w :], r[0, 1:] / r[0, 0]
    q, s = np.linalg.qr(own)
    turn = np.linalg.inv(s)
    inner = q.T @ product @ turn
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    top = np.argsort(values)[::-1][:k]
    theta, vectors = values[top], vectors[:, top]
    axis = turn @ vectors
    some = theta > 1e-10
    off = np.linalg.norm(product @ axis - q @ vectors * theta, axis=0)
    near = bool((~some | (off <= TOLERANCE * max(theta[0], 0))).all())
    scaled = np.zeros((w, k))
    scaled[:, : len(top)] = np.where(some, axis / np.sqrt(np.where(some, theta, 1.0)), 0.0)
    return near, (scaled, means[:w]), (scaled, means[w:]), _orthonormal(product, means[w:])


def _mapped(table: DataFrame, name: str, maps: dict, start: bool = False) -> DataFrame:
    """table with (y - mean) @ map by group as `name`; y is what _start makes of a block if start."""
    sent = table.sparkSession.sparkContext.broadcast(maps)
    kept = [c for c in table.columns if c != "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n, key = row.column("n")[0].as_py(), row.column("key")[0].as_py()
                turn, mean = sent.value[key]
                y = _start({"x": row.column("x")[0].as_buffer(), "n": n, "b": row.column("b")[0].as_py()}) if start else _numbers(row.column("y")[0], n)
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in kept], pa.array([np.ascontiguousarray((y - mean) @ turn).tobytes()])], [*kept, name])

    kinds = dict(table.dtypes)
    return table.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + f", {name} binary")


def _largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            a = np.frombuffer(row["a"]).reshape(row["n"], -1)
            at = np.abs(a).argmax(0)
            k = a.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * k), pa.array([row["b"]] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(a[at, range(k)])], ["key", "b", "axis", "value"])


def _unpacked(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = row.column("ids").flatten()
                s = _numbers(row.column("s")[0], len(ids))
                groups = row.column("g").take(pa.array(np.zeros(len(ids), np.int64)))
                yield pa.RecordBatch.from_arrays([groups, ids, *[pa.array(np.ascontiguousarray(s[:, c])) for c in range(k)]], ["g", "id", *[f"k{c + 1}" for c in range(k)]])

    return run


def _chunks(rows: int, others: int) -> Iterator[tuple[int, int]]:
    return ((at, across) for across in range(0, others, ACROSS) for at in range(0, rows, CHUNK))


def _kernel(x: np.ndarray, others: np.ndarray, gamma: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """The kernel of rows and others, a chunk at a time; each chunk is gone with the next. One product gives the exponents."""
    left = np.concatenate([2 * gamma * x, -gamma * (x * x).sum(1)[:, None], np.ones((len(x), 1))], axis=1)
    right = np.concatenate([others, np.ones((len(others), 1)), -gamma * (others * others).sum(1)[:, None]], axis=1)
    for at, across in _chunks(len(x), len(others)):
        kernel = left[at : at + CHUNK] @ right[across : across + ACROSS].T
        np.minimum(kernel, 0, out=kernel)
        yield at, across, np.exp(kernel, out=kernel)


def _counting(asked: dict) -> Callable:
    """Counts of a tile's positive squared distances by the bins asked for; the bits of positive doubles order as they do."""

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("b")
        key, sizes = tile.column("key")[0].as_py(), tile.column("n").to_pylist()
        x = [_numbers(v, n) for v, n in zip(tile.column("x"), sizes, strict=True)]
        left, right, same = x[0], x[-1], len(x) == 1
        below = dict.fromkeys(asked[key], 0)
        bins = {w: np.zeros(1 << BINS_BITS, np.int64) for w in asked[key] if w[2]}
        single: dict[tuple, list] = {w: [] for w in asked[key] if not w[2]}
        for at, across in _chunks(len(left), len(right)):
            if same and across + ACROSS <= at:
                continue
            far = squared_distances(left[at : at + CHUNK], right[across : across + ACROSS], True)
            if same:
                far[across + np.arange(far.shape[1]) <= at + np.arange(len(far))[:, None]] = 0
            bits = far.view(np.int64).ravel()
            for w in asked[key]:
                low, high, shift = w
                if low > 1:
                    below[w] += int(np.count_nonzero((bits > 0) & (bits < low)))
                inside = bits[(bits >= low) & (bits < high)] - low
                if shift:
                    inside >>= shift
                    bins[w] += np.bincount(inside, minlength=1 << BINS_BITS)
                else:
                    single[w].append(inside)
        out: list[tuple[int, int, int]] = []
        for w, places in asked[key].items():
            if w[2]:
                which = np.flatnonzero(bins[w])
                counts = bins[w][which]
            else:
                which, counts = np.unique(np.concatenate(single[w]), return_counts=True)
            for t in places:
                out.append((np.full(len(which) + 1, t, np.int32), np.append(which, -1), np.append(counts, below[w])))
        t, which, counts = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"key": pa.array([key] * len(t)), "t": pa.array(t), "bin": pa.array(which.astype(np.int64)), "n": pa.array(counts.astype(np.int64))})

    return run


def _multiplying(gamma: dict[str, float]) -> Callable:
    """Products of the kernel between two blocks with the vectors of each."""

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("b")
        key, own, sizes = tile.column("key")[0].as_py(), tile.column("b").to_pylist(), tile.column("n").to_pylist()
        x, v = ([_numbers(m, n) for m, n in zip(tile.column(c), sizes, strict=True)] for c in ("x", "v"))
        y = [np.zeros(m.shape) for m in v]
        for at, across, kernel in _kernel(x[0], x[-1], gamma[key]):
            y[0][at : at + CHUNK] += kernel @ v[-1][across : across + ACROSS]
            if len(x) == 2:
                y[1][across : across + ACROSS] += kernel.T @ v[0][at : at + CHUNK]
        return pa.table({"key": pa.array([key] * len(own)), "b": pa.array(own, pa.int32()), "c": pa.array(own[::-1], pa.int32()), "y": pa.array([m.tobytes() for m in y])})

    return run


def _crossing(gamma: dict[str, float]) -> Callable:
    """Products of the kernel between a block of other rows and one of training rows with the training rows' loadings."""

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by("train")
        (rows, own), key = tile.column("n").to_pylist(), tile.column("key")[0].as_py()
        x, t, a = _numbers(tile.column("x")[0], rows), _numbers(tile.column("x")[1], own), _numbers(tile.column("a")[1], own)
        y = np.zeros((rows, a.shape[1]))
        for at, across, kernel in _kernel(x, t, gamma[key]):
            y[at : at + CHUNK] += kernel @ a[across : across + ACROSS]
        return pa.table({"key": pa.array([key]), "b": tile.column("i").slice(0, 1), "c": tile.column("j").slice(0, 1), "y": pa.array([y.tobytes()])})

    return run

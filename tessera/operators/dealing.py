"""Units dealt one after the other, where only their kind decides: folds and exact splits that keep families whole.

Each choice depends on those before it, but only through counts, and units of
one kind differ in nothing. So the driver walks over kinds and their numbers,
never over rows: for each kind it notes the sequence of choices, a byte a unit,
in pieces that are written out as they come. Units are numbered within their
kind, by a seeded hash, and look up their byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import stable_hex
from tessera.operators.numbering import running_in_groups
from tessera.session import kept_paths, scratch_dir

#: Choices of a piece, and choices and pieces that the driver holds: most kinds have few units, and a write costs the same for one piece as for thousands.
PIECE, HELD, HELD_PIECES = 1 << 16, 1 << 22, 1 << 14


def dealt(units: DataFrame, kind: list[str], order: list[Column], unit: str, seed: str, choose: Callable[[tuple], int], name: str) -> DataFrame:
    """units with the number that choose gives to each: kinds in the order, units of a kind by hash, one call a unit.

    choose gets the kind's columns and keeps its own counts; it has at most 256 answers.
    """
    spark = units.sparkSession
    placed = running_in_groups(units.withColumn("__kind", F.struct(*kind)).withColumn("__hash", stable_hex(F.lit(seed), F.col(unit))), "__kind", [F.col("__hash"), F.col(unit)], {"__place": F.lit(1).cast("bigint")})
    counts = units.groupBy(*kind).agg(F.count("*").alias("__n")).orderBy(*order)
    schema = units.select(F.struct(*kind).alias("__kind"), F.lit(0).cast("bigint").alias("__piece"), F.lit(b"").alias("__choices")).schema
    path = f"{scratch_dir(spark)}/dealt-{uuid.uuid4().hex}"
    kept_paths.append(path)
    held: list[tuple] = []
    choices = 0

    def write() -> None:
        spark.createDataFrame(held, schema).coalesce(1).write.mode("append").parquet(path)
        held.clear()

    for row in counts.toLocalIterator():
        own = tuple(row)[:-1]
        for piece, lo in enumerate(range(0, row["__n"], PIECE)):
            held.append((own, piece, bytes(choose(own) for _ in range(min(PIECE, row["__n"] - lo)))))
            choices += len(held[-1][2])
            if choices >= HELD or len(held) == HELD_PIECES:
                write()
                choices = 0
    if held or not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        write()
    pieces = spark.read.schema(schema).parquet(path)
    at = F.col("__place") - 1
    joined = placed.withColumn("__piece", F.floor(at / PIECE)).join(pieces, ["__kind", "__piece"])
    byte = F.conv(F.hex(F.substring("__choices", (at % PIECE + 1).cast("int"), F.lit(1))), 16, 10)
    return joined.select(*units.columns, byte.cast("int").alias(name))


class EvenFolds:
    """The fold in which a group makes the classes' shares over the folds most even; then the one with fewest rows, then the first."""

    def __init__(self, totals: list[int], folds: int):
        self.share = 1.0 / np.maximum(1, np.array(totals, float))
        self.held = np.zeros((folds, len(totals)))
        self.rows = np.zeros(folds)

    def __call__(self, kind: tuple) -> int:
        own = np.array(kind[0], float)
        x = self.held * self.share
        more = (self.held + own) * self.share
        k = len(x)
        mean = (x.sum(axis=0) + own * self.share) / k
        square = (x**2).sum(axis=0) + more**2 - x**2
        spread = np.sqrt(np.maximum(0, square / k - mean**2)).mean(axis=1)
        best = min(range(k), key=lambda i: (round(float(spread[i]), 9), self.rows[i], i))
        self.held[best] += own
        self.rows[best] += own.sum()
        return best


def stratified_group_folds(rows: DataFrame, group: str, label: str, folds: int, seed: str) -> DataFrame:
    """(group, fold): every group in one fold, and each class spread over the folds as evenly as that allows.

    Groups whose class counts vary most come first. A null label is a class of its own, a null group a group of its own.
    """
    classes = [r[0] for r in rows.select(label).distinct().limit(257).collect()]
    if len(classes) > 256:
        raise ValueError("more than 256 classes")
    classes.sort(key=lambda c: (c is None, str(c)))
    by_class = F.array(*[F.count_if(F.col(label).eqNullSafe(F.lit(c))) for c in classes]) if classes else F.array().cast("array<bigint>")
    groups = rows.groupBy(group).agg(by_class.alias("counts"))
    totals = rows.groupBy(label).count().collect()
    counted = {r[0]: r["count"] for r in totals}
    n = len(classes)
    mean = F.aggregate("counts", F.lit(0.0), lambda s, c: s + c) / max(1, n)
    spread = F.aggregate("counts", F.lit(0.0), lambda s, c: s + (c - mean) * (c - mean))
    order = [F.round(spread, 6).desc(), F.col("counts").desc()]
    return dealt(groups, ["counts"], order, group, seed, EvenFolds([counted[c] for c in classes], folds), "fold").select(group, "fold")


class ExactRoles:
    """The role with room for a family where squared distances from the population's share, and a twentieth of those from the role's size, grow least."""

    def __init__(self, targets: dict[str, int], populations: dict[object, int]):
        self.targets, total = list(targets.values()), max(1, sum(targets.values()))
        self.wanted = {p: [n * t / total for t in self.targets] for p, n in populations.items()}
        self.held = [0] * len(self.targets)
        self.own: dict[object, list[int]] = {p: [0] * len(self.targets) for p in populations}

    def __call__(self, kind: tuple) -> int:
        size, population = kind
        best = None
        for i, target in enumerate(self.targets):
            if self.held[i] + size > target:
                continue
            before, whole = self.own[population][i] - self.wanted[population][i], self.held[i] - target
            cost = (before + size) ** 2 - before**2 + 0.05 * ((whole + size) ** 2 - whole**2)
            found = (round(cost, 9), self.held[i] / target, i)
            best = found if best is None or found < best else best
        if best is None:
            raise ValueError(f"no role has room for a family of {size}")
        self.held[best[2]] += size
        self.own[population][best[2]] += size
        return best[2]


def exact_allocation(families: DataFrame, family: str, population: str, size: str, targets: dict[str, int], seed: str) -> DataFrame:
    """families with their role: roles get exactly their numbers of members, families stay whole, populations are spread in proportion.

    Larger families come first, then by population. A role's wish from a population is its share of the population's families.
    """
    total = families.agg(F.sum(size)).first()[0] or 0
    if total != sum(targets.values()):
        raise ValueError(f"{total} members for targets of {sum(targets.values())}")
    populations = {r[0]: r["count"] for r in families.groupBy(population).count().collect()}  # one row a population
    names = F.array(*[F.lit(r) for r in targets])
    out = dealt(families, [size, population], [F.col(size).desc(), F.col(population)], family, seed, ExactRoles(targets, populations), "__role")
    return out.withColumn("role", F.get(names, F.col("__role"))).drop("__role")

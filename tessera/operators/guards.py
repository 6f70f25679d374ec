"""Refusals and contract checks made before a plan is built, and block hold-outs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tessera.functions.keys import stable_hex
from tessera.operators import numbering
from tessera.session import keep

#: Splits that no evaluation may touch, and column names that identify persons (fixed values).
SEALED = frozenset({"test", "holdout"})
IDENTIFYING = frozenset({"name", "email", "phone", "address", "birth_date"})


def open_split(split: str, sealed: frozenset[str] = SEALED) -> str:
    """The split, or a refusal if it is sealed; there is no override."""
    if split in sealed:
        raise PermissionError(f"split {split} is sealed")
    return split


def ratio_map(arguments: list[str]) -> dict[str, float]:
    """NAME=SHARE arguments as a map; blanks, repeats and shares outside (0, 1] are refused."""
    out: dict[str, float] = {}
    for text in arguments:
        name, _, share = text.partition("=")
        name = name.strip()
        if not name or not share.strip() or name in out or not 0 < float(share) <= 1:
            raise ValueError(f"bad ratio {text!r}")
        out[name] = float(share)
    return out


def identifying_paths(schema: DataType, names: frozenset[str] = IDENTIFYING, at: str = "") -> list[str]:
    """Paths of fields, however deep, whose name is identifying."""
    if isinstance(schema, ArrayType):
        return identifying_paths(schema.elementType, names, at)
    if not isinstance(schema, StructType):
        return []
    found = []
    for f in schema.fields:
        path = f"{at}.{f.name}".lstrip(".")
        found += [path] * (f.name.lower() in names) + identifying_paths(f.dataType, names, path)
    return found


def only_eligible(sets: DataFrame, name: str, eligible: str, wanted: str | None = None) -> str | None:
    """The wanted set, else the only eligible one, else nothing."""
    rows = [r[0] for r in sets.where(F.col(name) == wanted if wanted else F.col(eligible)).select(name).limit(2).collect()]
    return rows[0] if len(rows) == 1 else None


def unchanged_by_order(df: DataFrame, run: Callable[[DataFrame], DataFrame], seed: int = 1) -> bool:
    """Whether a result is the same after dealing its input anew in another order."""
    a, b = run(df), run(df.repartition(7, F.rand(seed)))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def guarded_holdout(blocks: DataFrame, shares: dict[str, float], guard: int, seed: str) -> DataFrame:
    """blocks (chrom, block, start, stop) with role: train, a part, or buffer_<part>.

    For each part in turn, of all runs of as many free neighbouring blocks of one chromosome as its share of all blocks
    comes to (rounded half to even, one at least), that with the least seeded hash of its first and last block. Free
    blocks that overlap a chosen block widened by `guard` on both sides become the part's buffer.
    """
    now = keep(blocks.select("chrom", "block", "start", "stop").withColumn("role", F.lit("train")), "blocks")
    total = now.count()
    for part, share in shares.items():
        length = max(1, round(total * share))
        ahead = Window.partitionBy("chrom").orderBy("start", "stop", "block").rowsBetween(0, length - 1)
        free = F.count_if(F.col("role") == "train").over(ahead) == length
        runs = now.select("chrom", "start", F.col("block").alias("first"), F.last("block").over(ahead).alias("last"), F.last("stop").over(ahead).alias("end"), free.alias("free"))
        best = runs.where("free").orderBy(stable_hex(F.lit(seed), F.lit(part), "first", "last"), "chrom", "start").limit(1)
        if best.isEmpty():
            raise ValueError(f"no run can hold {length} blocks of {part}")
        chosen = F.broadcast(best.select(F.col("chrom").alias("c"), F.col("start").alias("s"), F.col("end").alias("e")))
        inside = (F.col("chrom") == F.col("c")) & (F.col("start") >= F.col("s")) & (F.col("stop") <= F.col("e"))
        near = (F.col("chrom") == F.col("c")) & (F.col("start") < F.col("e") + guard) & (F.greatest(F.lit(0), F.col("s") - guard) < F.col("stop"))
        role = F.when(inside, part).when(near & (F.col("role") == "train"), f"buffer_{part}").otherwise(F.col("role"))
        now = keep(now.crossJoin(chosen).select("chrom", "block", "start", "stop", role.alias("role")), "blocks")
    return now


def greedy_diverse(df: DataFrame, order: list[str], name: str, pos: str, vector: str, apart: int, most: float, k: int, shortlist: int = 10_000) -> DataFrame:
    """Up to k rows in the order given, each at least `apart` from all chosen before it and correlated with none beyond `most`.

    Every choice depends on those before it, so candidates go through one task in their order, and none after the k-th.
    Rows come to it in that order; of more than `shortlist` candidates the first are tried before any other is sent.
    """
    columns = [F.col(o.lstrip("-")).desc() if o.startswith("-") else F.col(o).asc() for o in order]
    placed = numbering.numbered(df, "place", *columns)
    kept: list[Row] = []
    lo = 0
    while len(kept) < k:
        batch = placed.where((F.col("place") >= lo) & (F.col("place") < lo + shortlist)).orderBy("place").collect()
        for row in batch:
            near = any(abs(row[pos] - other[pos]) < apart for other in kept)
            if len(kept) < k and not near and not any(abs(np.corrcoef(row[vector], other[vector])[0, 1]) > most for other in kept):
                kept.append(row)
        lo += shortlist
        if len(batch) < shortlist:
            break
    return df.sparkSession.createDataFrame([(r[name], i + 1) for i, r in enumerate(kept)], f"{name} {dict(df.dtypes)[name]}, rank int")


def greedy_apart(df: DataFrame, group: str, order: list[str], pos: str, apart: int, k: int) -> DataFrame:
    """By group: up to k rows in the order given, each at least `apart` from all chosen before it."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        for i, p in zip(frame.index, frame[pos], strict=True):
            if len(kept) < k and all(abs(p - frame.loc[j, pos]) >= apart for j in kept):
                kept.append(i)
        return frame.loc[kept]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return choose(frame.sort_values([o.lstrip("-") for o in order], ascending=[not o.startswith("-") for o in order]).reset_index(drop=True))

    return df.groupBy(group).applyInPandas(run, df.schema)

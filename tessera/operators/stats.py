"""Aggregates, ranks and summary statistics of cohort tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import numbering


def variant_quality(genotype: DataFrame) -> DataFrame:
    """By variant: n, called, class counts, allele frequency, minor allele frequency, missing rate."""
    d = F.col("dosage")
    rows = genotype.groupBy("variant").agg(F.count("*").alias("n"), F.count(d).alias("called"), *[F.count_if(d == k).alias(f"n{k}") for k in (0, 1, 2)], F.sum(d).alias("total"))
    af = F.col("total") / (2.0 * F.nullif("called", F.lit(0)))
    return rows.select("variant", "n", "called", "n0", "n1", "n2", af.alias("af"), F.least(af, 1 - af).alias("maf"), (1 - F.col("called") / F.col("n")).alias("missing_rate"))


def mean_imputed(genotype: DataFrame, quality: DataFrame) -> DataFrame:
    """genotype with value: the dosage, or twice the allele frequency where it is missing."""
    return genotype.join(quality.select("variant", "af"), "variant").select("variant", "sample", F.coalesce(F.col("dosage").cast("double"), 2 * F.col("af")).alias("value"))


def zero_imputed_scores(genotype: DataFrame, quality: DataFrame) -> DataFrame:
    """genotype with z: the dosage standardised by its allele frequency, 0 where it is missing."""
    spread = F.sqrt(F.greatest(2 * F.col("af") * (1 - F.col("af")), F.lit(1e-12)))
    return genotype.join(quality.select("variant", "af"), "variant").select("variant", "sample", F.coalesce((F.col("dosage") - 2 * F.col("af")) / spread, F.lit(0.0)).alias("z"))


def class_metrics(rows: DataFrame, groups: list[str], truth: str, chances: list[str]) -> DataFrame:
    """Cross-entropy and accuracy by group; the predicted class is the most likely one, the lowest of equals."""
    p = F.array(*chances)
    best = F.array_position(p, F.array_max(p)) - 1
    own = F.element_at(p, F.col(truth).cast("int") + 1)
    return rows.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(-F.log(F.greatest(own, F.lit(1e-12)))).alias("cross_entropy"), F.avg((best == F.col(truth)).cast("double")).alias("accuracy"))


def macro(cells: DataFrame, values: list[str]) -> DataFrame:
    """Plain means over cells, whatever their sizes."""
    return cells.agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("cells"))


QUANTILES = (0.001, 0.01, 0.25, 0.5, 0.75, 0.99, 0.999)


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float], method: str = "linear") -> DataFrame:
    """groups and, by name, the exact quantile of the values that are not null: interpolated, or the order statistic at or above its rank.

    Ranks come from the counts of distinct values, summed up in ranges over all groups, and each quantile picks the two values
    that it lies between; no task holds a group's values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("__k"))
    upto = numbering.running(counts, "__upto", F.col("__k"), *groups, value)
    starts = upto.groupBy(*groups).agg(F.min(F.col("__upto") - F.col("__k")).alias("__start"), F.sum("__k").alias("__n"))
    same = [F.col(f"u.{g}").eqNullSafe(F.col(f"s.{g}")) for g in groups]
    ranked = upto.alias("u").join(starts.alias("s"), same).select(*[F.col(f"u.{g}").alias(g) for g in groups], F.col(f"u.{value}").alias("__v"), (F.col("__upto") - F.col("__k") - F.col("__start")).alias("__from"), (F.col("__upto") - F.col("__start") - 1).alias("__to"), "__n")
    at = {name: (F.col("__n") - 1) * p for name, p in probs.items()}
    pick = lambda rank: F.max(F.when((F.col("__from") <= rank) & (rank <= F.col("__to")), F.col("__v")))
    ends = [c for name, h in at.items() for c in (pick(F.floor(h)).alias(f"__low_{name}"), pick(F.ceil(h)).alias(f"__high_{name}"))]
    found = ranked.groupBy(*groups, "__n").agg(*ends)
    low, high = (lambda name, side=side: F.col(f"__{side}_{name}") for side in ("low", "high"))
    between = lambda name, h: high(name) if method == "higher" else low(name) + (high(name) - low(name)) * (h - F.floor(h))
    return found.select(*groups, *[between(name, h).alias(name) for name, h in at.items()])


def described(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Mean, population sd, extremes, exact quantiles, skewness and excess kurtosis by group."""
    rows = df.groupBy(*groups).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurtosis"))
    names = {f"q{str(p)[2:]}": p for p in QUANTILES}
    quantiles = exact_quantiles(df, groups, value, names)
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"q.{g}")) for g in groups]
    return rows.alias("r").join(quantiles.alias("q"), same, "left").select("r.*", *[f"q.{n}" for n in names])


def value_shape(df: DataFrame, groups: list[str], value: str, digits: int = 6, far: float = 5.0) -> DataFrame:
    """Distinct rounded values, the most frequent one and its share, negatives, and values over `far` sd from the mean."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.bround(value, digits).alias("v")).agg(F.count("*").alias("k"))
    modes = counts.groupBy(*groups).agg(F.count("*").alias("distinct"), F.min_by("v", F.struct(-F.col("k"), F.col("v"))).alias("mode"), F.max("k").alias("top"), F.sum("k").alias("n"))
    moments = df.groupBy(*groups).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    tails = df.join(moments, groups).groupBy(*groups).agg(F.count_if(F.col(value) < 0).alias("negative"), F.count_if(F.abs(F.col(value) - F.col("m")) > far * F.col("s")).alias("far"))
    return modes.join(tails, groups).select(*groups, "n", "distinct", "mode", (F.col("top") / F.col("n")).alias("mode_share"), "negative", "far")


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))


def spearman(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation by group; 0 where either side is constant."""
    ranked = numbering.average_ranks(df.select(*groups, x, y), groups, x, "rx").drop("__n")
    ranked = numbering.average_ranks(ranked, groups, y, "ry")
    return ranked.groupBy(*groups).agg(F.coalesce(F.nanvl(F.corr("rx", "ry"), F.lit(0.0)), F.lit(0.0)).alias("rho"))


def strata_by_rank(df: DataFrame, value: str, bins: int, groups: list[str], name: str) -> DataFrame:
    """df with the bin of (average rank - 1) / n, from 0; unlike ntile, equal values share a bin."""
    ranked = numbering.average_ranks(df, groups, value, "__rank")
    return ranked.select(*df.columns, F.least(F.floor((F.col("__rank") - 1) / F.col("__n") * bins), F.lit(bins - 1)).cast("bigint").alias(name))


def r2_from_train_mean(y: str, prediction: str, train_mean: str) -> Column:
    """1 - squared error / squared distance from the training mean, as an aggregate; null if that is 0."""
    return 1 - F.sum((F.col(y) - F.col(prediction)) ** 2) / F.nullif(F.sum((F.col(y) - F.col(train_mean)) ** 2), F.lit(0.0))


def r2_from_own_mean(y: str, prediction: str) -> Column:
    """1 - squared error / squared distance from the rows' own mean, as an aggregate; 0 if that is 0."""
    spread = F.var_pop(y) * F.count(y)
    return F.when(spread > 0, 1 - F.sum((F.col(y) - F.col(prediction)) ** 2) / spread).otherwise(F.lit(0.0))


def train_standardised(df: DataFrame, values: list[str], is_train: Column) -> DataFrame:
    """Values less the training mean, by the training population sd (1 where that is 0)."""
    stats = df.where(is_train).agg(*[F.avg(v).alias(f"__m_{v}") for v in values], *[F.stddev_pop(v).alias(f"__s_{v}") for v in values])
    joined = df.crossJoin(F.broadcast(stats))
    scaled = {v: (F.col(v) - F.col(f"__m_{v}")) / F.when(F.col(f"__s_{v}") > 0, F.col(f"__s_{v}")).otherwise(1.0) for v in values}
    return joined.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def clipped_scores(df: DataFrame, value: str, is_train: Column, far: float = 5.0) -> DataFrame:
    """value clipped at the training mean +- far sd, then standardised by the training rows' clipped values."""
    first = df.where(is_train).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    held = df.crossJoin(F.broadcast(first)).withColumn(value, F.greatest(F.least(F.col(value), F.col("__m") + far * F.col("__s")), F.col("__m") - far * F.col("__s"))).drop("__m", "__s")
    return train_standardised(held, [value], is_train)


def rank_share(df: DataFrame, value: str, is_train: Column) -> DataFrame:
    """df with share: (training values below it + 0.5) / (training values + 1), before the inverse normal."""
    weight = is_train.cast("bigint")
    upto = numbering.running(df, "__upto", weight, value)
    below = F.col("__upto") - F.sum(weight).over(Window.partitionBy(value))
    total = F.broadcast(df.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("__n")))
    return upto.crossJoin(total).select(*df.columns, ((below + 0.5) / (F.col("__n") + 1)).alias("share"))


def one_hot(df: DataFrame, column: str, is_train: Column, most: int = 1000) -> DataFrame:
    """0/1 columns for the training levels in order, without the first; unseen levels are 0 everywhere."""
    levels = [r[0] for r in df.where(is_train).select(column).distinct().where(F.col(column).isNotNull()).orderBy(column).limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return df.select("*", *[F.coalesce((F.col(column) == x).cast("int"), F.lit(0)).alias(f"{column}_{x}") for x in levels[1:]])


def weighted_scores(scores: DataFrame, weights: DataFrame, groups: list[str]) -> DataFrame:
    """Sum over variants of z times the track's weight, by sample, track and group."""
    return scores.join(weights, "variant").groupBy("sample", "track", *groups).agg(F.sum(F.col("z") * F.col("w")).alias("score"))


def decayed_mean(value: Column, distance: Column, scale: float) -> Column:
    """Mean with weights exp(-distance / scale), as an aggregate."""
    w = F.exp(-distance / scale)
    return F.sum(w * value) / F.sum(w)

"""Cleaning of text values and small statistical formulas, as columns."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def number(text: Column) -> Column:
    """Text as a double; null where blank or unreadable."""
    return F.trim(text).try_cast("double")


def number_or_nan(text: Column) -> Column:
    return F.coalesce(number(text), F.lit(float("nan")))


def flag_code(text: Column, blank: str = "<blank>") -> Column:
    """A coded flag as integer text; unreadable codes stay as they are."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    whole = number(trimmed)
    return F.when(trimmed == "", F.lit(blank)).when(whole.isNull() | F.isnan(whole) | (F.abs(whole) > 1e15), trimmed).otherwise(whole.cast("bigint").cast("string"))


def truth(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))) == "true"


def exactly_one(a: Column, b: Column) -> Column:
    """Whether exactly one of two flags holds."""
    return a != b


def sign_class(value: Column, negative: str, positive: str, none: str = "NA") -> Column:
    return F.when(value < 0, negative).when(value > 0, positive).otherwise(none)


def bare_chromosome(text: Column) -> Column:
    return F.regexp_replace(text, "chr", "")


def slug(text: Column, empty: str = "state") -> Column:
    """Lower-case words joined by underscores."""
    cut = F.lower(F.regexp_replace(F.regexp_replace(text, "[^0-9A-Za-z]+", "_"), "^_+|_+$", ""))
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit(empty)).otherwise(cut)


def number_text(value: Column) -> Column:
    """A number as text: nothing for null and NaN, no point for whole numbers."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(value.isNull() | F.isnan(value), "").when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def dosage_of(a: Column, b: Column) -> Column:
    """Two called alleles (0 or 1) as a count; null for anything else."""
    return F.when(a.isin(0, 1) & b.isin(0, 1), a + b)


def single_base(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def hardy_weinberg(p: Column) -> list[Column]:
    """Chances of 0, 1 and 2 copies at allele frequency p."""
    return [(1 - p) * (1 - p), 2 * p * (1 - p), p * p]


def smoothed_shares(counts: list[Column], alpha: float = 0.5) -> list[Column]:
    total = sum(counts[1:], counts[0]) + alpha * len(counts)
    return [(c + alpha) / total for c in counts]


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper end of the binomial interval; null for no trials."""
    share, z2 = k / F.nullif(n, F.lit(0)), z * z
    middle, half = share + z2 / (2 * n), z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))
    return F.greatest(F.lit(0.0), (middle - half) / (1 + z2 / n)), F.least(F.lit(1.0), (middle + half) / (1 + z2 / n))


def on_grid(p: Column, draws: int) -> Column:
    """Whether a Monte-Carlo p-value is one of k/(draws+1), k from 1."""
    k = p * (draws + 1)
    return (F.abs(k - F.round(k)) < 1e-9) & (F.round(k) >= 1) & (F.round(k) <= draws + 1)


@F.arrow_udf(DoubleType())
def two_sided_p(z: pa.Array) -> pa.Array:
    """Two-sided normal p-value of z; neither Spark nor its SQL has erfc."""
    return pa.array([None if v is None else math.erfc(abs(v) / math.sqrt(2)) for v in z.to_pylist()], pa.float64())


@F.arrow_udf(DoubleType())
def normal_quantile(p: pa.Array) -> pa.Array:
    """Inverse of the standard normal distribution; null outside (0, 1)."""
    from statistics import NormalDist

    inverse = NormalDist().inv_cdf
    return pa.array([inverse(v) if v is not None and 0 < v < 1 else None for v in p.to_pylist()], pa.float64())

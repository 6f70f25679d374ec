"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. No stage has an SQL form: the classifier, the
shingle sets and the packing are not expressible.

Tables behind a stage go when the next one over the same input begins in the
same thread; runs in other threads keep theirs.

Defined cases, for every stage: an empty table gives an empty result; null and
empty texts are texts without words, kept or dropped like others; very long
texts are handled whole; rows that repeat are rows of their own, of which the
near-dedup stage keeps one; a null id or source is a value of its own; columns
that documents may have besides are carried, whatever their names. Each stage's
docstring says what it does beyond that.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, quality, simhash, suffixes
from tessera.session import collected, forget, keep, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


class _Needed(threading.local):
    """By input, the tables that this thread's last stage over it still needs for its result."""

    def __init__(self):
        self.by_input: dict[str, list[str]] = {}


_needed = _Needed()


def _follows(stage: Stage) -> Stage:
    """A stage whose docs were written and read again: the tables behind the stage before it can go."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        forget(spark, _needed.by_input.pop(sf_dir, []))
        return _first(stage)(spark, docs, sf_dir)

    return run_stage


def _first(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with collected() as paths:
            out = stage(spark, docs, sf_dir)
        _needed.by_input[sf_dir] = paths
        return out

    return run_stage


@_first
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; without labels of both classes all have one score and stay if it is 0.3 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_follows
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of five-word similarity 0.8 or more, stays: that of the smallest id, a null id last.

    Texts without words are copies of each other.
    """
    return simhash.one_of_each(docs, k=5, similarity=(4, 5))


@_follows
def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 bytes that start earlier go from the texts; characters go if all their bytes do. Null text stays null or becomes empty."""
    cleaned = suffixes.remove_repeats(docs, carry=docs.columns)
    text = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return cleaned.select(*[text.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


@_follows
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, by repeated, dropped and cut documents; texts without words take nothing and go."""
    return mixing.mixed_documents(docs)


@_follows
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences; an empty text is its end id."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", repeat_removal),
    ("source mixing", source_mixing),
    ("best-fit packing", packed_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

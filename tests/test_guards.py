from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import guards


def test_refusals(spark):
    assert guards.open_split("train") == "train"
    with pytest.raises(PermissionError):
        guards.open_split("test")
    assert guards.ratio_map(["train=0.8", "validation=0.2"]) == {"train": 0.8, "validation": 0.2}
    for bad in (["=1"], ["a="], ["a=0.1", "a=0.2"], ["a=2"]):
        with pytest.raises(ValueError):
            guards.ratio_map(bad)
    schema = spark.createDataFrame([], "a struct<Name: string, x: array<struct<email: string>>>, ok int").schema
    assert guards.identifying_paths(schema) == ["a.Name", "a.x.email"]


def test_only_eligible(spark):
    df = spark.createDataFrame([("a", True), ("b", False)], "n string, e boolean")
    assert guards.only_eligible(df, "n", "e") == "a" and guards.only_eligible(df, "n", "e", "b") == "b"
    assert guards.only_eligible(df.withColumn("e", F.lit(True)), "n", "e") is None


def test_greedy_apart_and_order(spark):
    df = spark.createDataFrame([("g", i, float(-i % 7)) for i in range(30)], "g string, pos long, score double")
    run = lambda d: guards.greedy_apart(d, "g", ["-score", "pos"], "pos", 5, 4)
    got = [r.pos for r in run(df).collect()]
    assert len(got) == 4 and all(abs(a - b) >= 5 for i, a in enumerate(got) for b in got[:i])
    assert guards.unchanged_by_order(df, run)

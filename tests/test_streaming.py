from __future__ import annotations

import json
import random

import pytest

from tessera.operators import curves
from tessera.streaming.curves import CURVE, appended, curve_stream, followed, windowed_loss


def test_stream_equals_batch(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    for n in range(3):
        (data / f"{n}.json").write_text("".join(json.dumps({"run": f"r{k % 2}", "step": 250 * (4 * n + k), "loss": 1 / (1 + k + n), "at": f"2024-01-01T00:{10 * n + 2 * k:02d}:00Z"}) + "\n" for k in range(4)))
    query = windowed_loss(curve_stream(spark, str(data))).writeStream.format("memory").queryName("curves").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    batch = windowed_loss(spark.read.schema(CURVE).json(str(data)))
    assert sorted(map(tuple, spark.table("curves").collect())) == sorted(map(tuple, batch.collect())) != []


def lines(rows):
    return "".join(json.dumps({"run": r, "step": s, "loss": x, "at": "2024-01-01T00:00:00Z"}) + "\n" for r, s, x in rows)


@pytest.fixture
def shuffles(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # state stores of a test
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_followed_runs_equal_the_batch_after_restarts(spark, tmp_path, shuffles):
    data, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()
    rng = random.Random(1)
    curve = {r: [(r, 250 * (k + 1), round(rng.random() + 5 / (k + 1), 6)) for k in range(n)] for r, n in (("a", 23), ("b", 7), ("c", 3), ("d", 12))}
    cuts = [0, 4, 5, 14, 23]
    for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
        rows = [x for r in curve.values() for x in r[lo:hi]]
        again = [x for r in curve.values() for x in r[max(0, lo - 2) : lo]]  # a writer that was restarted repeats lines
        rng.shuffle(rows)
        (tmp_path / "in" / f"{part}.json").write_text(lines(rows + again) + lines([(None, 1, 0.5), ("a", None, 0.5)]))
        query = appended(followed(curve_stream(spark, data)), out, checkpoint)
        assert query.awaitTermination(120)
        query = appended(followed(curve_stream(spark, data)), out, checkpoint)  # nothing new
        assert query.awaitTermination(120)
    found = spark.read.schema("run string, step bigint, loss double, rolling double, late_change double").json(out)
    got = {(r.run, r.step): r for r in found.collect()}
    assert found.count() == len(got) == sum(map(len, curve.values()))
    batch = spark.createDataFrame([x for r in curve.values() for x in r], "cell string, step bigint, metric double")
    rolling = {(r.cell, r.step): r.rolling for r in curves.rolling_mean(batch).collect()}
    assert {k: round(r.rolling, 9) for k, r in got.items() if r.rolling is not None} == {k: round(x, 9) for k, x in rolling.items() if x is not None}
    late = {r.cell: r.change for r in curves.late_change(batch, 4).collect()}
    for run, rows in curve.items():
        last = got[run, rows[-1][1]].late_change
        assert (last is None) == (late.get(run) is None) and (last is None or abs(last - late[run]) < 1e-12)

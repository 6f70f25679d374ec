"""Operators that SQL cannot check: brute force, identities and edge cases."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import keys, values
from tessera.operators import components, curves, graph, intervals, numbering, regression, relational, resample, sampling, stats


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(None, 1), (5, 5)]
    parent = list(range(80))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges[:-2]:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges[:-2] if a != b for x in (a, b)}
    assert found == {x: root(x) for x in touched}


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in graph.connected_components(path).collect()} == {0}
    assert graph.connected_components(path.where("a < 0")).count() == 0


def test_component_names_do_not_depend_on_edge_order(spark):
    nodes = spark.range(6).select(F.col("id").alias("node"))
    named = components.named_components(nodes, spark.createDataFrame([(1, 2), (3, 2)], "a long, b long"))
    rows = {r.node: (r.component_id, r["size"]) for r in named.collect()}
    assert rows[1] == rows[2] == rows[3] and rows[1][1] == 3 and rows[0][1] == 1 and rows[1][0].startswith("FC_")


def test_first_reason_takes_the_first_and_not_null(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, -5)], "a int, b int")
    rules = [("negative", F.col("b") < 0), ("big", F.col("a") > 1)]
    assert {r.reason: r.n for r in relational.reason_counts(df, rules).collect()} == {"retained": 1, "big": 1, "negative": 1}


def test_half_open_edges(spark):
    points = spark.createDataFrame([("c", p, p) for p in (9, 10, 19, 20)], "chrom string, pos long, id long")
    spans = spark.createDataFrame([("c", 10, 20, 1.5)], "chrom string, start long, stop long, score double")
    assert {r.id: r.value for r in intervals.cover_value(points, spans, "id").collect()} == {9: 0.0, 10: 1.5, 19: 1.5, 20: 0.0}


@pytest.mark.parametrize("width", [7, 100])
def test_overlap_join_counts_each_pair_once(spark, width):
    rng = random.Random(1)
    spans = [("c", s, s + rng.randrange(1, 40)) for s in rng.sample(range(300), 60)]
    df = spark.createDataFrame(spans, "chrom string, start long, stop long")
    got = sorted((r.start, r.stop, r.r_start, r.r_stop) for r in intervals.overlapping(df, df, width).collect())
    want = sorted((a[1], a[2], b[1], b[2]) for a in spans for b in spans if a[1] < b[2] and b[1] < a[2])
    assert got == want


def test_nonincreasing_fit_is_the_min_max_formula(spark):
    y = [3.0, 5.0, 4.0, 4.5, 1.0, 2.0, 0.5]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "cell string, step long, metric double")
    got = [r.fit for r in curves.nonincreasing_fit(df).orderBy("step").collect()]
    want = [min(max(np.mean(y[a : b + 1]) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    assert np.allclose(got, want)


def test_greedy_split_is_balanced_and_order_free(spark):
    units = spark.createDataFrame([("s", f"u{i}", 1 + i % 4) for i in range(60)], "stratum string, unit string, size long")
    shares = {"train": 0.6, "validation": 0.2, "test": 0.2}
    split = lambda df: {r.unit: r.split for r in sampling.greedy_split(df, "stratum", "unit", "size", shares, "x").collect()}
    first = split(units)
    assert first == split(units.orderBy(F.desc("unit")).repartition(3))
    size = {s: sum(1 + int(u[1:]) % 4 for u, t in first.items() if t == s) for s in shares}
    assert abs(size["train"] - 90) <= 4 and abs(size["test"] - 30) <= 4


def test_diverse_top_skips_conflicts():
    rows = pd.DataFrame({"pos": [10, 11, 50, 51, 90], "score": [9, 8, 7, 6, 5]})
    chosen = sampling.diverse_top(rows, 3, lambda a, b: abs(a.pos - b.pos) < 5)
    assert chosen.pos.tolist() == [10, 50, 90]


def test_even_thin_keeps_ends(spark):
    df = spark.createDataFrame([("g", i) for i in range(11)], "g string, i long")
    assert [r.i for r in sampling.even_thin(df, "g", ["i"], 5).orderBy("i").collect()] == [0, 2, 5, 8, 10]


def test_normal_functions(spark):
    df = spark.createDataFrame([(0.0, 0.5), (1.96, 0.975), (None, None), (-3.0, 1.0)], "z double, p double")
    rows = df.select(values.two_sided_p("z").alias("a"), values.normal_quantile("p").alias("b")).collect()
    assert rows[0].a == 1.0 and math.isclose(rows[1].a, math.erfc(1.96 / math.sqrt(2))) and rows[2].a is None
    assert abs(rows[0].b) < 1e-12 and math.isclose(rows[1].b, NormalDist().inv_cdf(0.975)) and rows[3].b is None


def test_keys_do_not_skip_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    a, b = (r.k for r in df.select(keys.stable_hex("x", "y").alias("k")).collect())
    assert a != b


def test_flag_codes(spark):
    df = spark.createDataFrame([(" 1.0 ",), ("",), (None,), ("x",), ("-1",)], "t string")
    assert [r.c for r in df.select(values.flag_code(F.col("t")).alias("c")).collect()] == ["1", "<blank>", "<blank>", "x", "-1"]


def test_regression_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(200, 2)), rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, a), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y, strict=True))], "a double, b double, y double, f long")
    design = np.column_stack([np.ones(200), x])
    assert np.allclose(regression.grams(df, ["a", "b"], "y")[0].solve(), np.linalg.lstsq(design, y, rcond=None)[0])
    folds = regression.grams(df, ["a", "b"], "y", F.col("f"))
    grid = [0.0, 5.0, 50.0]
    chosen, errors = regression.cross_validated_penalty(folds, grid)
    f = np.arange(200) % 4
    for p, e in zip(grid, errors, strict=True):
        total = 0.0
        for k in range(4):
            d, t = design[f != k], y[f != k]
            b = np.linalg.solve(d.T @ d + p * np.diag([0, 1, 1]), d.T @ t)
            total += ((y[f == k] - design[f == k] @ b) ** 2).sum()
        assert math.isclose(total, e, rel_tol=1e-9)
    assert chosen == grid[int(np.argmin(errors))]


def test_dual_ridge_is_the_primal_one():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 5)), rng.normal(size=30)
    penalty, w, center, mean, scale = regression.kernel_ridge(x, y, x[:5], y[:5], [3.0])
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(w, np.linalg.solve(z.T @ z + 3 * np.eye(5), z.T @ (y - y.mean())))


def test_principal_axes_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(100, 4)) * [3, 2, 1, 0.5]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>")
    mean, axes, variances = regression.principal_axes(df, "v", 2)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose(variances, want) and np.allclose(mean, x.mean(0))
    got = np.array([[r.a, r.b] for r in df.select("i", *[c.alias(n) for c, n in zip(regression.projected("v", mean, axes), "ab", strict=True)]).orderBy("i").collect()])
    assert np.allclose(got, (x - mean) @ axes)


def test_canonical_correlation_of_itself_is_one(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(r.tolist(), (2 * r).tolist()) for r in rng.normal(size=(60, 3))], "l array<double>, r array<double>")
    assert np.allclose(regression.canonical_correlations(df, "l", "r", 3), 1.0, atol=1e-6)


def test_principal_angles():
    a = np.eye(3)[:, :1]
    b = np.array([[1.0], [1.0], [0.0]])
    assert np.allclose(regression.principal_angles(a, b), [45.0])


def test_bootstrap_of_equal_arms_is_zero_and_repeats(spark):
    df = spark.createDataFrame([(i, float(i), 1.0, 1.0, 2.0) for i in range(20)], "k long, y double, a double, b double, m double")
    run = lambda d: resample.interval(resample.replicated(resample.numbered(d, ["k"]), 30, "s", [resample.gain("y", "a", "b", "m").alias("g")]), "g").first()
    assert run(df).low == run(df).high == 0.0
    other = df.withColumn("b", F.col("y"))
    assert run(other) == run(other.repartition(5)) and run(other).low > 0


def test_draw_weights_sum_to_n(spark):
    units = resample.numbered(spark.range(17).select(F.col("id").alias("k")), ["k"])
    assert {r.s for r in resample.draw_weights(units, 10, "x").groupBy("rep").agg(F.sum("w").alias("s")).collect()} == {17}


def test_permutation_stays_in_its_stratum(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(30)], "k long, g long, v double")
    rows = resample.permuted(df, "v", "k", 2, "s", "g").collect()
    assert len(rows) == 60 and all(int(r.permuted) % 3 == r.g for r in rows) and any(r.permuted != r.v for r in rows)


def test_family_wise_p_is_small_for_a_planted_signal(spark):
    terms = [("signal", i, 1.0 + 0.1 * (i % 3)) for i in range(12)] + [("noise", i, (-1.0) ** i) for i in range(12)]
    rows = {r.c: r.p for r in resample.largest_of_family(spark.createDataFrame(terms, "c string, u long, v double"), "c", "u", "v", 99, "s").collect()}
    assert rows["signal"] <= 0.05 < rows["noise"]


def test_group_folds_do_not_cross(spark):
    df = spark.createDataFrame([(i % 10, i) for i in range(50)], "g long, i long")
    assert relational.crossing_groups(resample.folds(df, "g", 3, "s"), "g", "fold").count() == 0


def test_same_partition_finds_differences(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "m long, l string")
    b = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "m long, l string")
    c = spark.createDataFrame([(1, "p"), (2, "q"), (3, "q")], "m long, l string")
    assert relational.same_partition(a, b, "m", "l").count() == 0
    assert relational.same_partition(a, c, "m", "l").count() > 0


def test_average_rank_and_value_shape(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 2.0, 5.0)], "g string, v double")
    assert sorted(r.r for r in numbering.average_ranks(df, ["g"], "v", "r").collect()) == [1.0, 2.5, 2.5, 4.0]
    shape = stats.value_shape(df, ["g"], "v").first()
    assert (shape["distinct"], shape["mode"], shape["mode_share"]) == (3, 2.0, 0.5)


def test_neighbours_and_ranks_carry_over_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(str(g), int(x), int(x) if rng.random() < 0.1 else None) for g in range(2) for x in rng.choice(4000, 900, replace=False)]
    df = spark.createDataFrame(rows, "g string, x long, k long").repartition(6)
    known = {g: sorted(k for h, _, k in rows if h == g and k is not None) for g in "01"}
    for r in numbering.nearest_known(df, "g", "x", F.col("k")).collect():
        below, above = [k for k in known[r.g] if k <= r.x], [k for k in known[r.g] if k >= r.x]
        assert (r["__back"], r["__ahead"]) == (max(below, default=None), min(above, default=None))
    tied = spark.createDataFrame([(i % 2, float(i * i % 17)) for i in range(300)], "g int, v double").repartition(5)
    values = {g: [r.v for r in tied.collect() if r.g == g] for g in (0, 1)}
    for r in numbering.average_ranks(tied, ["g"], "v", "rank").collect():
        own = values[r.g]
        assert r["rank"] == sum(v < r.v for v in own) + (own.count(r.v) + 1) / 2 and r["__n"] == len(own)


def test_map_tiles_begin_where_a_multiple_is_passed(spark):
    import math
    import random

    from tessera.operators.intervals import map_tiles

    rng, want, rows = random.Random(2), set(), []
    for chrom in ("1", "2", "X"):
        x, y, points = 0, 0.3, []
        for _ in range(60):
            x, y = x + rng.randrange(1, 40), y + rng.choice([0, 0.05, 0.4, 2.7])
            points.append((x, y))
        rows += [(chrom, a, b) for a, b in points]
        begun, limit = [points[0][0]], (math.floor(points[0][1] / 1.0) + 1) * 1.0
        for a, b in points[1:]:
            if b >= limit:
                begun.append(a)
                while b >= limit:
                    limit += 1.0
        begun.append(points[-1][0] + 1)
        want |= {(chrom, k, a - 1, b - 1) for k, (a, b) in enumerate(zip(begun, begun[1:], strict=False)) if b > a}
    df = spark.createDataFrame(rows, "chrom string, x long, y double").repartition(4)
    assert {tuple(r) for r in map_tiles(df, 1.0).collect()} == want
    assert map_tiles(df.where("x < 0"), 1.0).collect() == []


def test_exact_quantiles(spark):
    import random

    import numpy as np

    from tessera.operators.stats import described, exact_quantiles

    rng = random.Random(3)
    rows = [(g, rng.choice([1.5, 1.5, 2.0, None, rng.random() * 9])) for g in ["a", "b", None] for _ in range({"a": 301, "b": 7, None: 60}[g])] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, y double").repartition(5)
    probs = {"p0": 0.0, "p1": 0.1, "p5": 0.5, "p97": 0.97, "top": 1.0}
    for method in ("linear", "higher"):
        got = {r.g: r for r in exact_quantiles(df, ["g"], "y", probs, method).collect()}
        assert set(got) == {"a", "b", None, "one"}
        for g, r in got.items():
            own = np.array([y for h, y in rows if h == g and y is not None])
            assert np.allclose([r[n] for n in probs], np.quantile(own, list(probs.values()), method=method), atol=1e-12)
    table = {r.g: r for r in described(df, ["g"], "y").collect()}
    assert len(table) == 5 and table["none"].q5 is None and table["none"].n == 0
    assert abs(table["a"].q5 - np.median([y for g, y in rows if g == "a" and y is not None])) < 1e-12


def test_pairs_of_curves_that_cannot_be_compared(spark):
    from tessera.operators.curves import unpaired

    fit = lambda rows: spark.createDataFrame([(c, s, float(y)) for c, points in rows.items() for s, y in points], "cell string, step long, fit double")
    control = fit({"good": [(1, 5), (2, 3)], "steps": [(1, 5), (2, 3)], "more": [(1, 5), (2, 3), (3, 2)], "apart": [(1, 9), (2, 8)], "touch": [(1, 9), (2, 5)], "alone": [(1, 1)]})
    selected = fit({"good": [(1, 4), (2, 2)], "steps": [(1, 5), (3, 3)], "more": [(1, 5), (2, 3)], "apart": [(1, 3), (2, 1)], "touch": [(1, 5), (2, 1)], "other": [(1, 1)]})
    want = {"steps": "steps differ", "more": "steps differ", "apart": "no common range", "touch": "no common range", "alone": "one curve", "other": "one curve"}
    assert {r.cell: r.problem for r in unpaired(control, selected).collect()} == want

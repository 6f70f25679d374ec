"""Protocol operators against brute force and refits."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import guards, regression, sampling


def digest(*parts):
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


def test_leave_one_out_ridge_equals_refits(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    penalties = [0.1, 1.0, 10.0]
    for g in (0, 1):
        a = np.column_stack([np.ones(60), rng.normal(size=60)])
        x = rng.normal(size=(60, 6)) + a[:, 1:]
        x[:, 5] = 2.0  # no spread
        y = x[:, 0] - 0.5 * x[:, 1] + a[:, 1] + rng.normal(size=60)
        train, test = np.arange(45), np.arange(45, 60)
        rows += [(g, [*map(float, a[i]), *map(float, x[i]), float(y[i])], "train" if i < 45 else "test") for i in range(60)]
        bx, by = np.linalg.lstsq(a[train], x[train], rcond=None)[0], np.linalg.lstsq(a[train], y[train], rcond=None)[0]
        rx, ry = x - a @ bx, y - a @ by
        sd = rx[train].std(0)
        z = (rx / np.where(sd >= 1e-8, sd, np.inf))[:, :5]
        errors = []
        for p in penalties:
            e = []
            for i in train:
                left = train[train != i]
                w = np.linalg.solve(z[left].T @ z[left] + p * np.eye(5), z[left].T @ ry[left])
                e.append((ry[i] - z[i] @ w) ** 2)
            errors.append(float(np.mean(e)))
        best = int(np.argmin(errors))
        w = np.linalg.solve(z[train].T @ z[train] + penalties[best] * np.eye(5), z[train].T @ ry[train])
        spread = ((y[test] - y[train].mean()) ** 2).sum()
        want[g] = (penalties[best], errors[best], *[1 - ((y[test] - f) ** 2).sum() / spread for f in (a[test] @ by, a[test] @ by + z[test] @ w)])
    df = spark.createDataFrame(rows, "g long, x array<double>, role string").repartition(3)
    got = {r.g: (r.penalty, r.left_out_error, r.r2_a, r.r2_b) for r in regression.leave_one_out_ridge(df, "g", "x", 2, "role", penalties).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], rel=1e-8) for g in want)


def test_penalties_of_equal_error_take_the_larger():
    assert regression.least_penalty([2.0, 1.0, 1.0 + 5e-13, 1.5], [0.1, 1.0, 10.0, 100.0]) == 2
    assert regression.least_penalty([1.0, 1.0], [5.0, 2.0]) == 0


def test_greedy_split_breaks_ties_by_hash(spark):
    rng = random.Random(5)
    units = [(u, rng.choice([1, 1, 2, 3]), u % 3) for u in range(90)]
    shares = {"train": 0.6, "validation": 0.2, "test": 0.2}
    want = {}
    for stratum in range(3):
        own = sorted((x for x in units if x[2] == stratum), key=lambda x: (-x[1], digest("s", stratum, x[0])))
        total, held = sum(x[1] for x in own), dict.fromkeys(shares, 0)
        for u, n, _ in own:
            left = lambda part, n=n, held=held, total=total: round(sum((held[k] + n * (k == part) - shares[k] * total) ** 2 for k in shares), 6)
            best = min(shares, key=lambda part, u=u: (left(part), digest("s", stratum, u, part)))
            held[best] += n
            want[u] = best
    df = spark.createDataFrame(units, "unit long, size long, stratum long")
    got = {r.unit: r.split for r in sampling.greedy_split(df, "stratum", "unit", "size", shares, "s").collect()}
    assert got == want
    tied = [d for d in want.values() if d != "train"]
    assert {"validation", "test"} == set(tied)


def test_guarded_holdout_against_a_loop(spark):
    blocks = [(f"c{c}", f"c{c}b{i}", i * 100, i * 100 + 80) for c in range(3) for i in range(15)]
    shares, guard = {"test": 0.07, "validation": 0.1}, 150
    role = {b[1]: "train" for b in blocks}
    for part, share in shares.items():
        n = max(1, round(len(blocks) * share))
        runs = [blocks[i : i + n] for i in range(len(blocks) - n + 1)]
        runs = [r for r in runs if len({b[0] for b in r}) == 1 and all(role[b[1]] == "train" for b in r)]
        best = min(runs, key=lambda r: digest("h", part, r[0][1], r[-1][1]))
        for b in best:
            role[b[1]] = part
        for b in blocks:
            if role[b[1]] == "train" and any(b[0] == x[0] and b[2] < x[3] + guard and max(0, x[2] - guard) < b[3] for x in best):
                role[b[1]] = f"buffer_{part}"
    df = spark.createDataFrame(blocks, "chrom string, block string, start long, stop long").repartition(4)
    assert {r.block: r.role for r in guards.guarded_holdout(df, shares, guard, "h").collect()} == role
    with pytest.raises(ValueError, match="no run"):
        guards.guarded_holdout(df, {"test": 0.9}, 0, "h")


def test_kernel_axes_leave_empty_axes_at_zero():
    x = np.array([[0.0, 0.0], [0.0, 0.0], [1.0, 0.0], [1.0, 0.0]])
    scores = regression.kernel_axes(x, x, 3)
    assert np.allclose(scores[:, 1:], 0) and np.isfinite(scores).all()
    own = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1))  # the median of the positive distances is 1
    centered = own - own.mean(0) - own.mean(0)[:, None] + own.mean()
    assert np.isclose((scores[:, 0] ** 2).sum(), np.linalg.eigvalsh(centered)[-1])


def test_diverse_choice_goes_on_beyond_a_shortlist(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(-i), [float(x) for x in rng.normal(size=8)]) for i in range(40)]
    want = []
    for i, _, vec in rows:
        if len(want) < 5 and not any(abs(i - j) < 3 or abs(np.corrcoef(vec, rows[j][2])[0, 1]) > 0.3 for j in want):
            want.append(i)
    df = spark.createDataFrame(rows, "name long, score double, vec array<double>").repartition(3)
    for shortlist in (4, 100):
        got = guards.greedy_diverse(df, ["-score", "name"], "name", "name", "vec", 3, 0.3, 5, shortlist).orderBy("rank").collect()
        assert [r.name for r in got] == want


def test_block_components_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 10)) @ rng.normal(size=(10, 10))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>").repartition(3)
    got = {(r.id, r.block): r for r in regression.block_components(df, "id", "v", F.col("id") < 60, 4, 2).collect()}
    assert len(got) == 80 * 3
    for block in range(3):
        own = x[:, block * 4 : block * 4 + 4]
        values, axes = np.linalg.eigh(np.cov(own[:60], rowvar=False, bias=True))
        axes = axes[:, ::-1][:, :2]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(axes.shape[1])])
        scores = (own - own[:60].mean(0)) @ axes
        scores = scores / scores[:60].std(0)
        assert all(np.allclose(got[i, block].scores, scores[i], atol=1e-6) for i in range(80))
        assert got[0, block].share == pytest.approx(values[::-1][:2].sum() / values.sum())


def test_columns_named_in_the_head_of_a_file(spark, tmp_path):
    from tessera.sources.tables import named_in_head

    (tmp_path / "data.bin").write_bytes(b"\x00\xffn_31_0_0\x00junk f.21022.0.0\xfe" + b"\x01" * (1 << 20) + b"n_50_0_1")
    pattern = r"n_[0-9]+_[0-9]+_[0-9]+|f\.[0-9]+\.[0-9]+\.[0-9]+"
    assert named_in_head(spark, str(tmp_path / "data.bin"), pattern) == ["f.21022.0.0", "n_31_0_0", "n_50_0_1"]
    assert named_in_head(spark, str(tmp_path / "data.bin"), pattern, head=1000) == ["f.21022.0.0", "n_31_0_0"]

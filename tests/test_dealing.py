"""Folds and exact splits against plain loops over every unit."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.operators import dealing

SEPARATOR = "\u001f"


def by_hash(seed, name):
    return hashlib.sha256(f"{seed}{SEPARATOR}{'' if name is None else name}".encode()).hexdigest()


def plain_folds(rows, k, seed):
    classes = sorted({c for _, c in rows}, key=lambda c: (c is None, str(c)))
    total = Counter(c for _, c in rows)
    groups = defaultdict(Counter)
    for g, c in rows:
        groups[g][c] += 1
    vector = {g: [n[c] for c in classes] for g, n in groups.items()}
    spread = lambda v: round(sum((x - sum(v) / len(v)) ** 2 for x in v), 6)
    order = sorted(groups, key=lambda g: (-spread(vector[g]), [-x for x in vector[g]], by_hash(seed, g)))
    held, out = np.zeros((k, len(classes))), {}
    for g in order:
        scores = []
        for i in range(k):
            after = held.copy()
            after[i] += vector[g]
            scores.append((round(float((after / [total[c] for c in classes]).std(axis=0).mean()), 9), held[i].sum(), i))
        out[g] = min(scores)[2]
        held[out[g]] += vector[g]
    return out, held


@pytest.mark.parametrize(("k", "piece"), [(5, 1 << 16), (3, 4), (1, 2)])
def test_stratified_group_folds(spark, monkeypatch, k, piece):
    monkeypatch.setattr(dealing, "PIECE", piece)
    monkeypatch.setattr(dealing, "HELD", 3)
    rng = random.Random(k)
    rows = [(f"g{g}" if g else None, rng.choice(["a", "a", "b", "c", None])) for g in range(150) for _ in range(rng.choice([1, 1, 2, 3, 9]))]
    df = spark.createDataFrame(rows, "g string, y string").repartition(4)
    found = dealing.stratified_group_folds(df, "g", "y", k, "s").collect()
    want, held = plain_folds(rows, k, "s")
    assert len(found) == 150 and {r.g: r.fold for r in found} == want
    share = held / held.sum(axis=0)
    assert np.abs(share - 1 / k).max() < 0.08


def test_folds_of_nothing(spark):
    assert dealing.stratified_group_folds(spark.createDataFrame([], "g string, y string"), "g", "y", 3, "s").collect() == []


def plain_roles(families, targets, seed):
    roles, total = list(targets), sum(targets.values())
    pops = Counter(p for _, p, _ in families)
    wanted = {p: {r: n * targets[r] / total for r in roles} for p, n in pops.items()}
    held, own, out = Counter(), defaultdict(Counter), {}
    for name, pop, size in sorted(families, key=lambda f: (-f[2], f[1], by_hash(seed, f[0]))):
        options = []
        for k, r in enumerate(roles):
            if held[r] + size <= targets[r]:
                a, b = own[pop][r] - wanted[pop][r], held[r] - targets[r]
                options.append((round((a + size) ** 2 - a**2 + 0.05 * ((b + size) ** 2 - b**2), 9), held[r] / targets[r], k, r))
        role = min(options)[-1]
        held[role] += size
        own[pop][role] += size
        out[name] = role
    return out, held


def test_exact_allocation(spark):
    rng = random.Random(1)
    families = [(f"f{i}", rng.choice(["x", "y", "z"]), rng.choice([1, 1, 1, 2, 2, 3, 7])) for i in range(300)]
    total = sum(f[2] for f in families)
    targets = {"development": total // 3, "gate": total // 9, "test": total - total // 3 - total // 9}
    df = spark.createDataFrame(families, "family string, pop string, size long").repartition(3)
    found = dealing.exact_allocation(df, "family", "pop", "size", targets, "seed").collect()
    want, held = plain_roles(families, targets, "seed")
    assert {r.family: r.role for r in found} == want and dict(held) == targets and len(found) == 300
    with pytest.raises(ValueError, match="members for targets"):
        dealing.exact_allocation(df, "family", "pop", "size", {"a": 3}, "seed")
    whole = spark.createDataFrame([("f", "x", 2)], "family string, pop string, size long")
    with pytest.raises(ValueError, match="no role has room"):
        dealing.exact_allocation(whole, "family", "pop", "size", {"a": 1, "b": 1}, "seed")

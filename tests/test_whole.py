"""Queries over whole tables against brute force in Python."""

from __future__ import annotations

import random
import re
import statistics
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from tessera.plans.all import QUERIES

SF = "/root/testdata/sf0.001"


def columns(name, *wanted):
    return list(zip(*[pq.read_table(f"{SF}/{name}.parquet", columns=[c])[c].to_pylist() for c in wanted], strict=True))


def test_free_text_edges_whole(spark):
    want = set()
    for (text,) in columns("documents", "text"):
        ids = re.findall("[a-z]{4,5}", text or "")
        want |= {(min(p), max(p)) for p in zip(ids, ids[1:]) if p[0] != p[1]}  # noqa: B905
    got = [(r.a, r.b) for r in QUERIES["free_text_edges"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def edge_pairs():
    return {(min(c, o % 1500 + 1), max(c, o % 1500 + 1)) for c, o in columns("orders", "o_custkey", "o_orderkey") if c != o % 1500 + 1}


def union_find(pairs, nodes=()):
    parent = {x: x for x in [*nodes, *[x for p in pairs for x in p]]}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = defaultdict(set)
    for x in parent:
        groups[root(x)].add(x)
    return {frozenset(g) for g in groups.values()}


def test_components_of_all_orders(spark):
    want = Counter(len(g) for g in union_find(edge_pairs()))
    assert {r["size"]: r.components for r in QUERIES["component_sizes"](spark, SF).collect()} == want
    customers = [c for (c,) in columns("customer", "c_custkey")]
    own, found = set(customers), defaultdict(set)
    rows = QUERIES["component_ids"](spark, SF).collect()
    for r in rows:
        found[r.component_id].add(r.node)
    assert {frozenset(g & own) for g in found.values()} - {frozenset()} == {g & own for g in union_find(edge_pairs(), customers)} - {frozenset()}
    assert {r.differing for r in rows} == {0}


def test_kinship_of_all_orders(spark):
    k = [(31 * a + b) % 1000 for a, b in edge_pairs()]
    assert tuple(QUERIES["kinship_thresholds"](spark, SF).first()) == (len(k), sum(x >= 354 for x in k), sum(x >= 177 for x in k), min(k), max(k))


def test_cluster_bootstrap_takes_all_customers(spark, monkeypatch):
    from tessera.operators import resample

    units, numbered = [], resample.numbered
    monkeypatch.setattr(resample, "numbered", lambda u, by: units.append(u) or numbered(u, by))
    assert QUERIES["cluster_bootstrap"](spark, SF).first().replicates == 100
    assert {r.id for r in units[0].collect()} == {c for (c,) in columns("orders", "o_custkey")}


def min_max_fit(values):
    mean = lambda lo, hi: sum(values[lo : hi + 1]) / (hi + 1 - lo)
    return [min(max(mean(lo, hi) for hi in range(i, len(values))) for lo in range(i + 1)) for i in range(len(values))]


def test_whole_curves(spark, tmp_path):
    rng = random.Random(2)
    curves = {(u, kind): [100 - 2 * i * u + rng.gauss(0, 20) + (60 if i >= 35 else 0) for i in range(45)] for u in (1, 2) for kind in ("view", "click")}
    rows = [(u * 1000 + i * 2 + (kind == "view"), u, kind, x) for (u, kind), xs in curves.items() for i, x in enumerate(xs)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    fits = {f"{u}:{kind}": min_max_fit(xs) for (u, kind), xs in curves.items()}
    got = {(r.cell, r.step): r.fit for r in QUERIES["curve_nonincreasing_fit"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({(cell, i + 1): x for cell, fit in fits.items() for i, x in enumerate(fit)}, abs=1e-6)
    want = {}
    for u in ("1", "2"):
        a, b = fits[f"{u}:view"], fits[f"{u}:click"]
        hi, lo = min(a[0], b[0]), max(a[-1], b[-1])
        first = lambda fit, level: next(i + 1 for i, x in enumerate(fit) if x <= level)
        levels = [hi - (hi - lo) * k / 6 for k in range(1, 6)]
        want[u] = statistics.median(first(a, x) / first(b, x) for x in levels)
    assert {r.cell: r.speedup for r in QUERIES["curve_acceleration"](spark, str(tmp_path)).collect()} == pytest.approx(want)


def test_order_invariance_takes_all_variants(spark, monkeypatch):
    from tessera.operators import guards
    from tessera.plans import views

    sf, seen, whole = SF.replace("0.001", "0.01"), [], guards.unchanged_by_order
    monkeypatch.setattr(guards, "unchanged_by_order", lambda df, run: seen.append(df.count()) or whole(df, run))
    assert QUERIES["order_invariance"](spark, sf).first().unchanged
    assert seen == [views.genotype(spark, sf).count()]


def test_family_wise_p_takes_all_suppliers(spark):
    sf, values = SF.replace("0.001", "0.01"), defaultdict(list)
    rows = pq.read_table(f"{sf}/lineitem.parquet", columns=["l_returnflag", "l_suppkey", "l_discount"]).to_pylist()
    for r in rows:
        values[r["l_returnflag"], r["l_suppkey"]].append(r["l_discount"] - 0.05)
    want = {}
    for flag in {f for f, _ in values}:
        terms = [sum(x) / len(x) for (f, _), x in values.items() if f == flag]
        want[flag] = abs(sum(terms)) / sum(t * t for t in terms) ** 0.5
    assert {r.candidate: r.statistic for r in QUERIES["family_wise_p"](spark, sf).collect()} == pytest.approx(want)


def test_rows_outside_the_old_subsets(spark):
    for name, source in (("p_on_grid", "orders"), ("metadata_reconciliation", "customer"), ("arm_registry", "embeddings")):
        assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()

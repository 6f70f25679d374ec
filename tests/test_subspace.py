"""Subspace iteration against the exact decomposition."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import subspace


def exact(x, rank):
    values, vectors = np.linalg.eigh(np.cov(x.T))
    return vectors[:, ::-1][:, :rank], values[::-1][:rank]


def table(spark, x, parts):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(len(x), None)], "k long, e array<double>").repartition(parts)


@pytest.mark.parametrize(("n", "d", "rank", "parts"), [(300, 12, 3, 5), (200, 40, 5, 40), (7, 20, 2, 3), (50, 4, 9, 2)])
def test_leading_subspace_is_the_exact_one(spark, n, d, rank, parts):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)) @ np.diag(np.linspace(3, 0.3, d)) + rng.normal(size=d)
    found = subspace.leading_subspace(table(spark, x, parts), "e", rank)
    basis, values = exact(x, min(rank, d))
    assert found.rows == n and np.allclose(found.values, values, rtol=1e-9)
    assert subspace.principal_angles(basis, found.basis).max() < 1e-6
    assert np.allclose(found.basis.T @ found.basis, np.eye(min(rank, d)), atol=1e-12)


def test_embeddings(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    x = np.array([r.embedding for r in spark.read.parquet(path).orderBy("vec_id").collect()], float)
    found = subspace.leading_subspace(spark.read.parquet(path).repartition(20), "embedding", 4, oversample=28)
    assert subspace.principal_angles(exact(x, 4)[0], found.basis).max() < 1e-6


def test_energies_do_not_depend_on_the_basis(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8)) * np.arange(1, 9)
    df = table(spark, x, 3)
    found = subspace.leading_subspace(df, "e", 3)
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turned = subspace.Subspace(found.mean, found.basis @ turn, found.values, found.rows, found.passes)
    one, two = ({r.id: (r.inside, r.outside) for r in subspace.energies(df, "k", "e", s).collect()} for s in (found, turned))
    assert len(one) == 60 and all(np.allclose(one[k], two[k], rtol=1e-10) for k in one)
    centred = x - x.mean(axis=0)
    assert all(np.isclose(sum(one[k]), (centred[k] ** 2).sum()) for k in one)


def test_tree_of_triangles(spark):
    """More parts than one level joins; the triangle is that of all rows together."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    rows = table(spark, x, 300).where("e is not null").select(F.col("e").alias("v"))
    vectors = np.linalg.qr(rng.normal(size=(6, 3)))[0]
    product, r = subspace.multiplied(rows, x.mean(axis=0), vectors)
    c = x - x.mean(axis=0)
    assert np.allclose(product, c.T @ (c @ vectors)) and np.allclose(r.T @ r, (c @ vectors).T @ (c @ vectors))


def test_refusals(spark):
    with pytest.raises(ValueError, match="lengths"):
        subspace.leading_subspace(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "e array<double>"), "e", 1)
    with pytest.raises(ValueError, match="lengths"):
        subspace.leading_subspace(spark.createDataFrame([], "e array<double>"), "e", 1)
    x = np.random.default_rng(6).normal(size=(40, 10))
    with pytest.raises(ValueError, match="still turns"):
        subspace.leading_subspace(table(spark, x, 2), "e", 2, oversample=1, most=3)

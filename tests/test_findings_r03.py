"""Small cases of the findings of round 3."""

from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import sampling


def test_greedy_split_adds_and_rounds_as_sql(spark):
    """F8: three squares near 1e9, added in SQL's order without compensation, decide which splits tie."""
    rows = [("s", f"u{i}", 5000 + i % 7) for i in range(400)]
    shares = {"train": 0.6, "validation": 0.2, "test": 0.2}
    digest = lambda *x: hashlib.sha256("\x1f".join(x).encode()).hexdigest()
    total, held, want, con = float(sum(r[2] for r in rows)), [0.0] * 3, {}, duckdb.connect()
    for _, unit, n in sorted(rows, key=lambda r: (-r[2], digest("x", r[0], r[1]))):
        away = [[held[j] + n * (i == j) - s * total for j, s in enumerate(shares.values())] for i in range(3)]
        left = [con.execute("SELECT round($1 * $1 + $2 * $2 + $3 * $3, 6)", a).fetchall()[0][0] for a in away]
        best = min(range(3), key=lambda i: (left[i], digest("x", "s", unit, list(shares)[i])))
        held[best] += n
        want[unit] = list(shares)[best]
    units = spark.createDataFrame(rows, "stratum string, unit string, size long")
    assert {r.unit: r.split for r in sampling.greedy_split(units, "stratum", "unit", "size", shares, "x").collect()} == want


@pytest.mark.parametrize("parts", [1, 7])
def test_head_audit_takes_the_same_rows_of_one_key(spark, tmp_path, parts):
    """rows that share both keys at the cut are told apart by their other columns."""
    from tessera.plans.contracts import head_audit

    rows = [(1, 9 - i % 9, 1, "A" if i % 2 else "N") for i in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").repartition(parts).write.parquet(f"{tmp_path}/lineitem.parquet")
    first = sorted((r[1], r[3]) for r in rows)[:100]
    assert head_audit(spark, str(tmp_path)).first()["phased"] == sum(f == "N" for _, f in first)


def test_nearest_known_only_looks_back(spark):
    """a frame that ends with its partition costs the square of the rows."""
    from tessera.operators.numbering import nearest_known

    df = spark.createDataFrame([("a", i, i % 3) for i in range(20)], "g string, x long, k long")
    found = nearest_known(df, "g", "x", F.when(F.col("k") == 0, F.col("x")))
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert {(r.x, r["__back"], r["__ahead"]) for r in found.collect()} == {(i, i - i % 3, None if i > 18 else -(-i // 3) * 3) for i in range(20)}


def test_half_as_many_vectors_as_columns_take_one_pass(spark):
    """vectors without leading directions took hundreds of passes."""
    from tessera.operators.subspace import leading_subspace

    x = np.random.default_rng(3).normal(size=(400, 16))
    found = leading_subspace(spark.createDataFrame([(r.tolist(),) for r in x], "e array<double>"), "e", 2, oversample=6)
    assert found.passes == 1 and np.allclose(found.values, np.linalg.eigvalsh(np.cov(x.T))[::-1][:2])


def test_small_pieces_are_written_together(spark, monkeypatch):
    """a write for every 64 kinds of units."""
    from pyspark.sql import DataFrameWriter

    from tessera.operators import dealing

    writes, parquet = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (writes.append(path), parquet(self, path, *a, **k))[1])
    units = spark.range(400).select(F.col("id").alias("u"), (F.col("id") % 200).alias("k"))
    assert dealing.dealt(units, ["k"], [F.col("k")], "u", "s", lambda kind: kind[0] % 5, "fold").where("fold != k % 5").count() == 0
    assert sum("/dealt-" in p for p in writes) == 1


def test_grouped_ridge_is_the_dual_one_from_sums(spark):
    """a group's rows met in one task, which held the square of their number."""
    from tessera.operators import regression

    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 4)) + 50
    x[:, 3] = 7.3
    t = x[:, :3] @ [1.0, -2.0, 0.5] + rng.normal(size=90)
    role = np.array(["train", "train", "validation", "evaluation", "other"])[np.arange(90) % 5]
    rows = [(i % 2, x[i].tolist(), float(t[i]), str(role[i])) for i in range(90)] + [(2, [0.0] * 4, 0.0, "other")]
    found = regression.grouped_ridge(spark.createDataFrame(rows, "g long, x array<double>, y double, r string").repartition(3), "g", "x", "y", "r", [0.1, 1.0, 10.0])
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.replace("FlatMapGroupsInPandas", "").count("MapInPandas") == 1 and plan.count("Aggregate") == 1  # rows are added up before a group's task
    got = {r.g: (r.penalty, r.r2) for r in found.collect()}
    for g in (0, 1):
        own = {r: [i for i in range(g, 90, 2) if role[i] == r] for r in ("train", "validation", "evaluation")}
        penalty, w, center, mean, scale = regression.kernel_ridge(x[own["train"]], t[own["train"]], x[own["validation"]], t[own["validation"]], [0.1, 1.0, 10.0])
        e = own["evaluation"]
        r2 = 1 - ((((x[e] - mean) / scale) @ w + center - t[e]) ** 2).sum() / ((t[e] - t[own["train"]].mean()) ** 2).sum()
        assert got[g][0] == penalty and np.isclose(got[g][1], r2, rtol=1e-9)
    assert set(got) == {0, 1, 2} and got[2] == (None, None)


@pytest.mark.parametrize(("samples", "n"), [(1, 0), (1, 1), (9, 1), (300, 0), (300, 37), (300, 38), (5000, 64), (5000, 65), (5000, 400), (60_000, 30), (70_000, 129), (200_000, 3)])
def test_called_samples_make_short_records(samples, n):
    """a record held two bits for every sample."""
    from tessera.sources import pgen

    rng = np.random.default_rng(samples + n)
    places, codes = np.sort(rng.choice(samples, n, replace=False)), rng.integers(0, 3, n).astype(np.int8)
    kind, data = pgen.encoded_calls(places, codes, samples)
    want = np.full(samples, 3)
    want[places] = codes
    assert (pgen.decode_record(kind, np.frombuffer(data, np.uint8), samples, None) == want).all()
    assert len(data) <= -(-samples // 4) and (n > samples // 8 or samples < 20 or (kind == 7 and len(data) <= 8 + 4 * n))
    for wrong in ([samples], [0, 0], [-1]):
        with pytest.raises(ValueError, match="calls are"):
            pgen.encoded_calls(np.array(wrong), np.zeros(len(wrong), int), samples)


def test_pgen_files_of_calls_are_as_large_as_the_calls(spark, tmp_path):
    """variants times samples values were made, written and read."""
    from tessera.sources import matrices, pgen

    n, width, path = pgen.BLOCK + 900, 4000, str(tmp_path / "c.pgen")
    many = F.sequence(F.lit(0), F.lit(width - 1), F.lit(2)).cast("array<int>")  # half of the samples, of one variant
    few = F.when(F.col("row") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("row") % 7).cast("int"), (F.col("row") % 3900 + 8).cast("int")))
    rows = spark.range(n).withColumnRenamed("id", "row").withColumn("places", F.when(F.col("row") == 77, many).otherwise(few))
    rows = rows.withColumn("dosages", F.transform("places", lambda p: ((p + F.col("row")) % 3).cast("tinyint")))
    matrices.write_called_pgen(rows, path, n, width)
    import os

    assert os.path.getsize(path) < 12 * n + width and pgen.read_head(path).variants == n
    got = pgen.read_called(spark, path)
    want = rows.select("row", F.col("places").alias("p"), F.col("dosages").alias("d"))
    assert got.count() == n == got.join(want, F.col("variant_index") == F.col("row")).where("places = p and dosages = d").count()
    dense = pgen.read_pgen(spark, path).where("variant_index in (0, 77, 65535, 65536, 66435)")
    for r in dense.collect():
        own = got.where(F.col("variant_index") == r.variant_index).first()
        assert {i: d for i, d in enumerate(r.dosages) if d >= 0} == dict(zip(own.places, own.dosages, strict=True)) and len(r.dosages) == width
    with pytest.raises(Exception, match="is missing"):
        matrices.write_called_pgen(rows.where("row != 5"), str(tmp_path / "d.pgen"), n, width)


def test_called_reads_every_record_type(tmp_path):
    from tests.test_matrices import drawn, write_pgen

    from tessera.sources import pgen

    kinds = [0, 2, 3, 1, 2, 7, 2, 3, 7, 4, 3, 6, 2, 7, 2, 0]
    matrix = drawn(np.random.default_rng(4), len(kinds), 300, kinds)
    reader = pgen.CalledReader({"path": write_pgen(tmp_path / "x.pgen", matrix, kinds), "rows": "3"})
    for variant, who, what in (x for p in reader.partitions() for x in reader.called(p)):
        assert dict(zip(who.tolist(), what.tolist(), strict=True)) == {i: c for i, c in enumerate(matrix[variant]) if c != 3}


@pytest.mark.parametrize("width", [1, 7, 4000])
def test_bed_files_from_calls(spark, tmp_path, width):
    """a value of eight bytes was made for every sample of every variant."""
    from tessera.sources import genotypes, matrices

    n = 3000
    rows = spark.range(n).withColumnRenamed("id", "row").withColumn("places", F.when(F.col("row") % 3 == 1, F.array().cast("array<int>")).otherwise(F.array_distinct(F.array((F.col("row") % width).cast("int"), F.lit(width - 1), F.lit(width // 2)))))
    rows = rows.withColumn("dosages", F.transform("places", lambda p: ((p + F.col("row")) % 3).cast("tinyint")))
    matrices.write_called_bed(rows, str(tmp_path / "h.bed"), n, width)
    (tmp_path / "h.bim").write_text("1\tv\t0\t1\tA\tC\n" * n)
    (tmp_path / "h.fam").write_text("f i 0 0 1 -9\n" * width)
    want = {r.row: dict(zip(r.places, r.dosages, strict=True)) for r in rows.collect()}
    called = genotypes.read_plink_called(spark, str(tmp_path / "h"), 700).collect()
    assert {r.variant_index: dict(zip(r.places, r.dosages, strict=True)) for r in called} == want and len(called) == n
    for r in genotypes.read_plink(spark, str(tmp_path / "h"), 1000).where("variant_index < 1500").collect():
        assert {i: d for i, d in enumerate(r.dosages) if d is not None} == want[r.variant_index] and len(r.dosages) == width


def test_vcf_parts_name_the_samples_they_call(spark, tmp_path):
    """every line had a cell for every sample; and records beyond position 2^29 were lost behind a tabix index."""
    from tessera.sources import indexed

    n = 6000
    name = lambda x: F.concat(F.lit("s"), x.cast("string"))
    few = F.array(name(F.col("id")), name(F.col("id") + 1), name(F.col("id") % 3))
    rows = spark.range(n).withColumn("samples", F.when(F.col("id") % 4 == 3, F.array().cast("array<string>")).otherwise(F.array_distinct(few)))
    rows = rows.select(F.when(F.col("id") < 5000, "1").otherwise("2").alias("chrom"), (F.col("id") * 200_000 + 1).alias("pos"), F.col("id").cast("string"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), "samples", F.transform("samples", lambda x: F.when(x == "s0", "10/2:9").when(x == "s1", "0/1").otherwise("1/1")).alias("calls"))
    path = str(tmp_path / "c")
    indexed.write_called_vcf(rows, path)
    files = indexed._files(path)
    assert len(files) >= 6 and sum(len(indexed.vcf_samples(f)) for f in files) < 3 * n  # and not 6001 each
    want = {r.id: dict(zip(r.samples, (c.split(":")[0] for c in r.calls), strict=True)) for r in rows.collect()}
    for where in ("true", "chrom = '1' and pos >= 530000000 and pos < 545000000", "chrom = '2'", "chrom = '1' and pos > 900000000", "chrom = '1' and pos < 2"):
        got = indexed.read_called_vcf(spark, path).where(where).collect()
        own = {r.id for r in rows.where(where).select("id").collect()}
        assert {r.id: dict(zip(r.samples, r.calls, strict=True)) for r in got} == {k: want[k] for k in own} and len(got) == len(own) > 0


def test_long_positions_have_an_index(tmp_path):
    from tessera.sources import indexed

    path = str(tmp_path / "l.vcf.gz")
    w = indexed.BlockWriter(path)
    w.line("\t".join([*indexed.FIXED, "a"]))
    at = [(c, p) for c in ("1", "2") for p in (1, 5 << 20, (1 << 29) - 3, (1 << 29) + 5, (1 << 31) + 9)]
    for c, p in at:
        w.record(c, p, 40_000 if p == 5 << 20 else 9, f"{c}\t{p}\tx\tA\tC\t.\t.\t.\tGT\t0/1")
    w.close()
    assert w.index_path.endswith(".csi")
    for low, high in ((0, 1 << 40), (5 << 20, 1 << 29), (1 << 29, 1 << 30), ((1 << 31) + 9, 1 << 32), (1 << 32, 1 << 33)):
        reader = indexed.VcfReader({"path": path})
        reader.low, reader.high = low, high
        got = [x for p in reader.partitions() for b in reader.read(p) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert got == [x for x in at if low <= x[1] <= high]


@pytest.mark.parametrize("width", [4])
def test_kernel_scores_of_blocks_are_those_of_the_whole_matrix(spark, monkeypatch, width):
    """a group's training rows x rows were held in one task."""
    from tessera.operators import kernels, regression

    monkeypatch.setattr(kernels, "SINGLE", 100)
    rng = np.random.default_rng(5)
    x = {g: rng.normal(size=(150 + 40 * i, 3)) * [3.0, 2.0, 1.0] for i, g in enumerate("abc")}
    x["a"][60:120] = x["a"][5]  # copies
    x["b"][:] = 0.3
    x[None], x["d"] = x["a"][:90] + 1, rng.normal(size=(1, 3))
    train = {g: max(3, len(v) // 2) for g, v in x.items()}
    train["c"] = 0
    rows = [(g, i, v[i].tolist(), i + 1, i < train[g]) for g, v in x.items() for i in range(len(v))]
    df = spark.createDataFrame(rows, "g string, id long, x array<double>, place long, t boolean").repartition(5)
    found = {(r.g, r.id): (r.k1, r.k2) for r in kernels.kernel_scores(df, "g", "id", "x", "place", F.col("t"), 2, small=80, width=width).collect()}
    assert len(found) == len(rows)
    for g, v in x.items():
        got = np.array([found[g, i] for i in range(len(v))])
        if g in ("a", None):
            want = regression.kernel_axes(v, v[: train[g]], 2)
            signs = np.sign((got * want).sum(0))
            assert np.allclose(got, want * signs, atol=1e-7), g
        else:
            assert (np.abs(got) < 1e-7).all()  # equal rows, no training rows, one row
    medians = kernels._Blocks(df.where("g = 'a'").select(F.col("g").alias("key"), "g", "id", "x", "place", F.col("t").alias("train")), "string", "bigint", width).medians()
    own = x["a"][: train["a"]]
    far = ((own[:, None] - own) ** 2).sum(2)[np.triu_indices(len(own), 1)]
    assert np.isclose(medians["a"], np.median(far[far > 0]), rtol=1e-12)


def test_kernel_components_train_on_the_first_ids(spark, tmp_path):
    """training rows were the first to arrive."""
    from tessera.operators import regression
    from tessera.plans.statistics import kernel_components

    x = np.random.default_rng(6).normal(size=(60, 4)).astype(np.float32)
    rows = [(i, x[i].tolist(), 4 * (i % 3)) for i in reversed(range(60))]
    spark.createDataFrame([*rows, (60, None, 0), (61, [0.5] * 4, None)], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.g, r.k1, r.k2) for r in kernel_components(spark, str(tmp_path)).collect()}
    want = regression.kernel_axes(x.astype(float), x[:30].astype(float), 2)
    assert got.keys() == {*range(60), 61} and got[61] == (None, 0, 0)
    assert np.allclose(np.array([got[i][1:] for i in range(60)]), want)


def test_documents_are_walked_in_one_pass(spark, monkeypatch):
    """each level of nesting was written, and rules joined the values again by id and path."""
    from pyspark.sql import DataFrameWriter

    from tessera.operators import inventory

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: pytest.fail("a write"))
    deep = '{"a":[' * 400 + '{"eids":1}' + "]}" * 400
    rows = [("one", '{"blocking": []}'), ("one", "{}"), ("deep", deep), ("twice", '{"a": 1, "a": 2}'), (None, '{"": {"blocking": 1}, "algorithm": 7}')]
    found = inventory.violations(spark.createDataFrame(rows, "i string, j string"), "i", "j", required=["blocking"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.id or "", r.problem, r.path) for r in found.collect())
    want = [("one", "missing", "blocking"), ("deep", "missing", "blocking"), ("deep", "forbidden key", ".".join(["a[0]"] * 400 + ["eids"])), ("twice", "no object", ""), ("", "missing", "blocking"), ("", "unknown algorithm", "algorithm")]
    assert got == sorted(want)


def test_declared_texts_of_scalars_are_those_of_the_parser(spark):
    from tessera.operators import inventory

    for text in ("1", "-0", "1.5", "1.50", "1e2", "1.25E-7", "1e300", "12345678901234567890123456789012345678901", "true", "false", '"é\\u0041 1"', '""'):
        df = spark.createDataFrame([("x", f'{{"v": {text}}}')], "i string, j string")
        (own,) = df.select(F.try_variant_get(F.try_parse_json("j"), "$.v", "string")).first()
        assert own is not None and inventory.violations(df, "i", "j", constants={"v": own}).collect() == [], (text, own)

"""Readers and writers on small files with the awkward cases."""

from __future__ import annotations

import gzip
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import genotypes, sinks, tables


def put(path, text: str) -> str:
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_tsv_keyed_and_strata(spark, tmp_path):
    path = put(tmp_path / "t.tsv", "﻿eid\tx\ty\n1\ta\t \n2\tb\tq\n1\tc\t\n\td\tz\n")
    assert tables.read_tsv(spark, path).columns[0] == "eid"
    rows = {r.eid: r.x for r in tables.read_keyed(spark, path, "eid", ["x"]).collect()}
    assert rows == {"1": "c", "2": "b"}
    assert {r.eid: r.y for r in tables.read_strata(spark, path, "eid", ["y"]).collect()} == {"1": "NA", "2": "q"}
    with pytest.raises(ValueError, match="nope"):
        tables.read_keyed(spark, path, "eid", ["nope"])
    with gzip.open(tmp_path / "g.tsv.gz", "wt") as f:
        f.write("a\tb\n1\t2\n")
    assert tables.read_tsv(spark, str(tmp_path / "g.tsv.gz")).first().b == "2"


def test_id_lists(spark, tmp_path):
    path = put(tmp_path / "ids.txt", "# note\n a x\n\nb\ny  z\na q\n")
    assert sorted(r.id for r in tables.read_ids(spark, path).collect()) == ["a", "b", "y"]
    fam = put(tmp_path / "s.fam", "f1 i1 0 0 1 -9\nf2 i2 0 0 2 -9\n")
    assert [r.id for r in tables.read_sample_ids(spark, fam).orderBy("n").collect()] == ["i1", "i2"]
    psam = put(tmp_path / "s.psam", "#IID SEX\np1 1\n")
    assert [r.id for r in tables.read_sample_ids(spark, psam).collect()] == ["p1"]
    first = put(tmp_path / "f.csv", "sample,pop\nx,1\ny,2\n")
    assert [r.id for r in tables.read_first_column(spark, first).collect()] == ["x", "y"]


def test_kinship_and_relationships(spark, tmp_path):
    path = put(tmp_path / "k.txt", "FID1 ID1 FID2 ID2 N_SNP Kinship\n f a f b 10 0.25\n f b f a 10 0.26\n f c f d 10 0.01\n f e f e 9 0.5\n f x f y 1 bad\n")
    pairs, bad = tables.read_kinship(spark, path, 0.1)
    assert [tuple(r) for r in pairs.collect()] == [("a", "b", 0.26)] and bad.first()[0] == 1
    rel = spark.createDataFrame([("a", "sib: b, c"), ("b", "parent: a"), ("c", "self: c")], "id string, text string")
    allowed = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [tuple(r) for r in tables.relationship_edges(rel, "text", "id", allowed).collect()] == [("a", "b")]
    assert tables.aliased(spark.createDataFrame([("s", "")], "Sample string, pop string"), {"sample": ("sample",), "pop": ("pop",), "sex": ("sex",)}).first() == ("s", "UNKNOWN", "UNKNOWN")


def test_metrics_bed_scores_and_curves(spark, tmp_path):
    good = put(tmp_path / "m.tsv", "1\t10\tA\tC\t1\t4\t0.25\t0.25\t0\n")
    assert tables.read_metrics(spark, good).first().maf == 0.25
    bad = put(tmp_path / "b.tsv", "1\t10\tA\n")
    with pytest.raises(Exception):  # noqa: B017
        tables.read_metrics(spark, bad).collect()
    bed = put(tmp_path / "x.bed", "track name=x\nchr1\t5\t9\tn\t2.5\n2\t1\t3\n\n")
    assert [(r.chrom, r.start, r.stop, r.score) for r in tables.read_bed(spark, bed).orderBy("chrom").collect()] == [("1", 5, 9, 2.5), ("2", 1, 3, 1.0)]
    scores = put(tmp_path / "p.tsv", "chrom\tpos\ts\nchr1\t5\t1\n1\t5\t2\n1\t6\tNaN\n1\t7\tx\n")
    assert [(r.pos, r.score) for r in tables.read_point_scores(spark, scores, "s").collect()] == [(5, 2.0)]
    curve = put(tmp_path / "c.jsonl", "".join(json.dumps({"step": s, "loss": 1 / s}) + "\n" for s in (250, 500)))
    assert [tuple(r) for r in tables.read_curve(spark, curve, "loss").orderBy("step").collect()] == [(250, 0.004), (500, 0.002)]
    genes = spark.createDataFrame([("chr1", "+", 100, 200), ("chr1", "-", 50, 101), ("chr2", "-", 0, 9)], "chrom string, strand string, start long, stop long")
    assert sorted((r.chrom, r.tss) for r in tables.promoter_windows(genes).collect()) == [("1", 100), ("2", 8)]


def test_long_matrix_and_inventory(spark, tmp_path):
    wide = spark.createDataFrame([("g1", 1, 2, 3), ("g2", 4, 5, 6)], "gene string, `s.1` int, s2 int, s3 int")
    got = tables.long_matrix(wide, ["gene"], ["s.1", "s2"])
    assert sorted(tuple(r) for r in got.collect())[0] == ("g1", "s.1", 1.0) and got.count() == 4
    for name in ("a.bed", "a.bim", "a.fam", "b.bed", "kinship.txt"):
        (tmp_path / name).write_bytes(b"xx")
    files = tables.inventory(spark, str(tmp_path))
    assert {r.kind: r["count"] for r in files.groupBy("kind").count().collect()} == {"genotype": 4, "kinship": 1}
    assert {r.stem.rsplit("/", 1)[1]: r.complete for r in tables.filesets(files).collect()} == {"a": True, "b": False, "kinship": False}


def test_plink(spark, tmp_path):
    rng = np.random.default_rng(0)
    variants, samples = 23, 11
    dosage = rng.integers(-1, 3, (variants, samples))
    code = {2: 0, -1: 1, 1: 2, 0: 3}
    packed = bytearray(genotypes.MAGIC)
    for row in dosage:
        for lo in range(0, samples, 4):
            packed.append(sum(code[int(d)] << 2 * i for i, d in enumerate(row[lo : lo + 4])))
    stem = str(tmp_path / "p")
    (tmp_path / "p.bed").write_bytes(packed)
    (tmp_path / "p.bim").write_text("".join(f"{1 + v % 2}\tv{v}\t0\t{v * 10}\tA\tC\n" for v in range(variants)))
    (tmp_path / "p.fam").write_text("".join(f"f {'-' if s == 3 else ''}{s} 0 0 {1 + s % 2} -9\n" for s in range(samples)))
    read = genotypes.read_plink(spark, stem, rows=7)
    got = {r.variant_index: [-1 if d is None else d for d in r.dosages] for r in read.collect()}
    assert got == {v: dosage[v].tolist() for v in range(variants)} and read.rdd.getNumPartitions() == 4
    bim, fam = genotypes.read_bim(spark, f"{stem}.bim"), genotypes.read_fam(spark, f"{stem}.fam")
    long = genotypes.long_genotypes(read, bim, fam)
    assert long.where("variant_id = 'v5' and sample = '2'").first().dosage == (None if dosage[5, 2] < 0 else dosage[5, 2])
    assert genotypes.sample_summary(fam).first()[:3] == (11, 1, 0)
    assert {r.chrom: r.variants for r in genotypes.variant_summary(bim).collect()} == {"1": 12, "2": 11}
    (tmp_path / "p.bed").write_bytes(packed[:-1])
    with pytest.raises(Exception, match="bytes for"):
        genotypes.read_plink(spark, stem).collect()


def test_vcf_bgen_npy(spark, tmp_path):
    vcf = put(tmp_path / "v.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQ\tF\tI\tFORMAT\ts1\ts2\n1\t5\tr\tA\tC\t.\t.\t.\tGT\t0|1\t./.\n1\t9\tq\tA\tG\t.\t.\t.\tGT:DP\t1/1:3\t0|2:1\n")
    rows = genotypes.read_vcf(spark, vcf)
    assert {(r.pos, r.sample): r.dosage for r in rows.collect()} == {(5, "s1"): 1, (5, "s2"): None, (9, "s1"): 2, (9, "s2"): None}
    assert genotypes.phase_audit(rows).first() == (2, 1, 0.5)
    assert genotypes.phase_audit(rows.where("pos = 0")).first().share is None
    head = struct.pack("<IIII4s", 20, 20, 7, 3, b"bgen") + struct.pack("<I", 1 | 2 << 2 | 1 << 31)
    assert genotypes.bgen_header(head) == {"offset": 20, "variants": 7, "samples": 3, "compression": 1, "layout": 2, "sample_ids": 1}
    np.save(tmp_path / "m.npy", np.arange(12).reshape(4, 3))
    assert [r["values"] for r in genotypes.read_npy(spark, str(tmp_path / "m.npy"), 3).orderBy("row").collect()][3] == [9.0, 10.0, 11.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    sinks.write_tsv(df, f"{tmp_path}/t", ["k"])
    assert [r.k for r in tables.read_tsv(spark, f"{tmp_path}/t").collect()] == ["1", "2"]
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_tsv(df, f"{tmp_path}/t")
    assert json.loads(sinks.summary_document(df.agg(F.count("*").alias("n"), F.max("k").alias("k")))) == {"n": 2, "k": 2}
    files = sinks.bundle(spark, f"{tmp_path}/out", {"a": df, "b": df.where("k = 1")})
    before = spark.createDataFrame(files.collect(), files.schema)
    assert sinks.changed(before, sinks.digests(spark, f"{tmp_path}/out")).count() == 0
    digest = sinks.tree_digest(before)
    (tmp_path / "out" / "extra").write_text("x")
    assert [(r.name, r.change) for r in sinks.changed(before, sinks.digests(spark, f"{tmp_path}/out")).collect()] == [("extra", "new")]
    assert sinks.tree_digest(sinks.digests(spark, f"{tmp_path}/out")) != digest

    def broken(path):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.published(spark, f"{tmp_path}/never", lambda p: sinks.write_json(df, p), broken)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("never")]

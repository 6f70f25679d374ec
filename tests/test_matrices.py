"""PGEN records of every storage mode, and matrices written by many tasks."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import genotypes, matrices, pgen


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def packed(codes):
    codes = [*codes, *[0] * (-len(codes) % 4)]
    return bytes(sum(c << 2 * k for k, c in enumerate(codes[i : i + 4])) for i in range(0, len(codes), 4))


def listed(where, codes, samples):
    """A difference list, by the format's words: count, first numbers, sizes, codes, steps."""
    if not where:
        return varint(0)
    groups = [where[i : i + 64] for i in range(0, len(where), 64)]
    steps = [b"".join(varint(b - a) for a, b in zip(g, g[1:])) for g in groups]  # noqa: B905
    width = (samples.bit_length() + 7) // 8
    return varint(len(where)) + b"".join(g[0].to_bytes(width, "little") for g in groups) + bytes(len(s) - 63 for s in steps[:-1]) + packed([codes[i] for i in where]) + b"".join(steps)


def record(kind, codes, base, samples):
    if kind == 0:
        return packed(codes)
    if kind == 1:
        pair = sorted(sorted(range(4), key=lambda c: -codes.count(c))[:2])
        bits = np.packbits([c == pair[1] for c in codes], bitorder="little").tobytes()
        other = [i for i, c in enumerate(codes) if c not in pair]
        return bytes([pair[0] * 4 + pair[1] - pair[0]]) + bits + listed(other, codes, samples)
    if kind in (2, 3):
        swap = {0: 2, 1: 1, 2: 0, 3: 3} if kind == 3 else {c: c for c in range(4)}
        want = [swap[c] for c in codes]
        return listed([i for i in range(samples) if want[i] != base[i]], want, samples)
    return listed([i for i, c in enumerate(codes) if c != kind & 3], codes, samples)


def write_pgen(path, matrix, kinds, length_bytes=2, wide=False, extra=b"", flags=0, allele_bytes=0):
    """A variable-width file with the given record type for each variant."""
    n, samples = len(matrix), len(matrix[0])
    records, base = [], None
    for codes, kind in zip(matrix, kinds, strict=True):
        records.append(record(kind & 7, list(codes), base, samples) + extra)
        if kind & 6 != 2:
            base = list(codes)
    blocks = range(0, n, pgen.BLOCK)
    body, offsets, at = b"", [], 0
    for lo in blocks:
        own, k = records[lo : lo + pgen.BLOCK], kinds[lo : lo + pgen.BLOCK]
        body += bytes(k) if wide else bytes(k[i] | (k[i + 1] if i + 1 < len(k) else 0) << 4 for i in range(0, len(k), 2))
        body += b"".join(len(r).to_bytes(length_bytes, "little") for r in own) + bytes(allele_bytes * len(own)) + (bytes(-(-len(own) // 8)) if flags == 3 else b"")
        offsets.append(at)
        at += sum(map(len, own))
    start = 12 + 8 * len(offsets) + len(body)
    head = b"\x6c\x1b\x10" + n.to_bytes(4, "little") + samples.to_bytes(4, "little") + bytes([length_bytes - 1 + 4 * wide + 16 * allele_bytes + 64 * flags])
    path.write_bytes(head + b"".join((start + o).to_bytes(8, "little") for o in offsets) + body + b"".join(records))
    return str(path)


def drawn(rng, variants, samples, kinds):
    rows, base = [], None
    for kind in kinds:
        p = {0: [0.4, 0.3, 0.2, 0.1], 1: [0.48, 0.02, 0.48, 0.02], 4: [0.97, 0.01, 0.01, 0.01], 6: [0.01, 0.02, 0.96, 0.01], 7: [0.01, 0.01, 0.02, 0.96]}.get(kind & 7)
        if p is None:
            row = base.copy()
            near = rng.random(samples) < 0.03
            row[near] = rng.integers(0, 4, near.sum())
            if kind & 7 == 3:
                row = np.array([2, 1, 0, 3])[row]
        else:
            row = rng.choice(4, samples, p=p)
            base = row
        rows.append(row)
    return np.array(rows).tolist()


def as_dosage(matrix):
    return np.where(np.array(matrix) == 3, -1, np.array(matrix)).tolist()


@pytest.mark.parametrize(("samples", "length_bytes", "wide", "extra"), [(1, 1, False, b""), (7, 2, True, b""), (255, 2, False, b""), (256, 3, True, b"\1\2"), (3001, 4, True, b"\0" * 9)])
def test_every_record_type(spark, tmp_path, samples, length_bytes, wide, extra):
    rng = np.random.default_rng(samples)
    kinds = [0, 2, 3, 1, 2, 2, 3, 4, 3, 6, 2, 7, 2, 0, 4, 2, 1, 3]
    matrix = drawn(rng, len(kinds), samples, kinds)
    marked = [k | (8 * (i % 3 == 1) if wide else 0) for i, k in enumerate(kinds)]  # tracks behind the hardcalls
    path = write_pgen(tmp_path / "x.pgen", matrix, marked, length_bytes, wide, extra, flags=3 * wide, allele_bytes=int(wide))
    for rows in (1, 4, 5, 100):
        read = pgen.read_pgen(spark, path, rows)
        got = read.collect()
        assert {r.variant_index: r.dosages for r in got} == dict(enumerate(as_dosage(matrix))) and len(got) == len(kinds)
    assert read.rdd.getNumPartitions() == 1
    null = {r.variant_index: r.dosages for r in pgen.read_pgen(spark, path, 6, "null").collect()}
    assert null[0] == [None if c == 3 else c for c in matrix[0]]


def test_partitions_begin_at_base_records(tmp_path):
    rng = np.random.default_rng(1)
    kinds = [0, 2, 2, 2, 2, 2, 4, 3, 3, 0, 2]
    matrix = drawn(rng, len(kinds), 40, kinds)
    path = write_pgen(tmp_path / "x.pgen", matrix, kinds)
    reader = pgen.PgenReader({"path": path, "rows": "2"})
    read = [[v for v, _ in reader.records(p)] for p in reader.partitions()]
    assert read == [[0, 1, 2, 3, 4, 5], [], [], [6, 7, 8], [9, 10], []]


def test_blocks_of_variants(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pgen, "BLOCK", 4)
    rng = np.random.default_rng(2)
    kinds = [0, 2, 4, 2, 1, 3, 2, 2, 6, 2]
    matrix = drawn(rng, len(kinds), 70, kinds)
    path = write_pgen(tmp_path / "x.pgen", matrix, kinds, 1, False, flags=3)
    reader = pgen.PgenReader({"path": path, "rows": "3"})
    got = {v: c.tolist() for p in reader.partitions() for v, c in reader.records(p)}
    assert got == dict(enumerate(matrix)) and len(reader.partitions()) == 5


def test_broken_files(spark, tmp_path):
    matrix = [[0, 1, 2, 3, 0]] * 3
    good = write_pgen(tmp_path / "g.pgen", matrix, [0, 2, 2])
    data = open(good, "rb").read()
    for name, raw, why in (("short", data[:-1], "early"), ("magic", b"xx" + data[2:], "not a PGEN"), ("mode", data[:2] + b"\x30" + data[3:], "not a PGEN"), ("kind", data[:11] + b"\x08" + data[12:], "of kind")):
        (tmp_path / name).write_bytes(raw)
        with pytest.raises(Exception, match=why):
            pgen.read_pgen(spark, str(tmp_path / name)).collect()
    with pytest.raises(ValueError, match="no base"):
        pgen.decode_record(2, np.zeros(1, np.uint8), 5, None)
    with pytest.raises(ValueError, match="reserved"):
        pgen.decode_record(5, np.zeros(1, np.uint8), 5, None)
    fixed = matrices.header("pgen", 2, 5, "") + bytes(3)
    (tmp_path / "fixed").write_bytes(fixed)
    with pytest.raises(Exception, match="bytes for"):
        pgen.read_pgen(spark, str(tmp_path / "fixed")).collect()


def test_pvar(spark, tmp_path):
    path = tmp_path / "a.pvar"
    path.write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\n18\t5\ta\tA\tC\n18\t4\tb\tA\tC,G\n19\t9\ta\tA\tT\n")
    rows = pgen.read_pvar(spark, str(path))
    assert [(r.variant_index, r.pos, r.variant_id) for r in rows.orderBy("variant_index").collect()] == [(0, 5, "a"), (1, 4, "b"), (2, 9, "a")]
    assert {tuple(r) for r in pgen.pvar_problems(rows, "18", 4).collect()} == {("chromosome", 1), ("order", 1), ("alternates", 1), ("repeated id", 1), ("count", 3)}
    path.write_text("#CHROM\tPOS\n")
    with pytest.raises(ValueError, match="PVAR"):
        pgen.read_pvar(spark, str(path))


def test_matrices_by_many_tasks(spark, tmp_path):
    n, width = 500, 9
    df = spark.range(n).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: (F.col("id") * 7 + j * 3) % 5 - 1.0).alias("v"), F.lit(1).alias("row"))
    want = np.array([[(i * 7 + j * 3) % 5 - 1.0 for j in range(width)] for i in range(n)])
    for dtype in ("<f8", "<f4", "|i1"):
        path = str(tmp_path / f"{dtype[1:]}.npy")
        matrices.write_matrix(df, path, "npy", n, width, "k", "v", dtype)
        got = np.load(path)
        assert got.dtype == np.dtype(dtype) and (got == want).all()
    with pytest.raises(Exception, match="FileExists"):
        matrices.write_matrix(df, path, "npy", n, width, "k", "v")
    matrices.write_matrix(df.withColumn("v", F.transform("v", lambda x: x + 1)), path, "npy", n, width, "k", "v", overwrite=True)
    assert (np.load(path) == want + 1).all()
    hard = df.withColumn("v", F.transform("v", lambda x: F.when(x < 2.5, x)))
    dosage = np.where(want > 2.5, -1, want).astype(int).tolist()
    matrices.write_matrix(hard, str(tmp_path / "h.pgen"), "pgen", n, width, "k", "v")
    assert {r.variant_index: r.dosages for r in pgen.read_pgen(spark, str(tmp_path / "h.pgen"), 64).collect()} == dict(enumerate(dosage))
    matrices.write_matrix(hard, str(tmp_path / "h.bed"), "bed", n, width, "k", "v")
    (tmp_path / "h.bim").write_text("1\tv\t0\t1\tA\tC\n" * n)
    (tmp_path / "h.fam").write_text("f i 0 0 1 -9\n" * width)
    assert {r.variant_index: [-1 if d is None else d for d in r.dosages] for r in genotypes.read_plink(spark, str(tmp_path / "h"), 64).collect()} == dict(enumerate(dosage))
    assert not [p for p in os.listdir(tmp_path) if p.endswith(".scratch")]


@pytest.mark.parametrize(("change", "why"), [(lambda d: d.where("k != 17"), "row 17 is missing"), (lambda d: d.union(d.where("k = 3")), "row 3 is there twice|row 4 is there twice"), (lambda d: d.withColumn("v", F.slice("v", 1, 2)), "not 3 values"), (lambda d: d.withColumn("k", F.col("k") + 1), "outside"), (lambda d: d.withColumn("k", F.when(F.col("k") < 30, F.col("k")).otherwise(F.raise_error(F.lit("task fails")).cast("bigint"))), "task fails")])
def test_an_incomplete_matrix_leaves_nothing(spark, tmp_path, change, why):
    df = spark.range(40).select(F.col("id").alias("k"), F.array(*[F.lit(1.0)] * 3).alias("v"))
    with pytest.raises(Exception, match=why):
        matrices.write_matrix(change(df), str(tmp_path / "x.npy"), "npy", 40, 3, "k", "v")
    assert os.listdir(tmp_path) == []


def test_a_repeated_task_changes_nothing(tmp_path):
    import pyarrow as pa

    writer = matrices.MatrixWriter({"path": str(tmp_path / "x.npy"), "kind": "npy", "rows": "4", "width": "2"}, False)
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([[float(r), r + 0.5] for r in rows])], ["row", "values"])

    def dies():
        yield batch([2])
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dies())
    first, again = writer.write(iter([batch([0, 1])])), writer.write(iter([batch([2, 3])]))
    writer.write(iter([batch([2, 3])]))  # a second attempt whose message is not kept
    writer.commit([first, again, None])
    assert np.load(tmp_path / "x.npy").tolist() == [[r, r + 0.5] for r in range(4)]

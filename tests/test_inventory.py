"""Violations in JSON documents against a recursive walk, and fingerprints of small and large files."""

from __future__ import annotations

import hashlib
import json
import os

import pytest

from tessera.operators import inventory
from tessera.sources import fingerprints

GOOD = {"schema_version": 1, "classification": "INVENTORY", "identifiers_included": False, "phenotype_read": False, "genotype_filesets": [{"fileset": "a", "files": [{"name": "a.bed", "digest": {"algorithm": "sha256_full", "covers_whole_file": True}}]}], "kinship_files": [{"name": "k", "parsed": {"parsed": True}}], "blocking": []}
RULES = {"required": ["schema_version", "blocking", "kinship_files"], "must_be_false": ["identifiers_included", "phenotype_read"], "constants": {"classification": "INVENTORY"}, "longest_list": 5}


def changed(**more):
    out = json.loads(json.dumps(GOOD)) | more
    return {k: v for k, v in out.items() if v != "DROP"}


DOCS = {
    "good": GOOD,
    "members": changed(kinship_files=[{"name": "k", "parsed": {"members": ["IID0", "IID1"]}}]),
    "deep": changed(a={"b": [[{"c": {"eid": 1}}], [[{"eids": []}]]]}),
    "missing": changed(blocking="DROP", identifiers_included="DROP"),
    "true": changed(identifiers_included=True, phenotype_read="false"),
    "class": changed(classification="OTHER"),
    "null": changed(classification=None, blocking=None, identifiers_included=None),
    "lists": changed(a=["x"] * 6, b=["x"] * 5, c=["x"] * 5 + [1], d=[["x"] * 6], e={"f": ["é"] * 60}, g=[None] * 9),
    "digest": changed(genotype_filesets=[{"files": [{"digest": {"algorithm": "md5"}}, {"digest": {"algorithm": None}}, {"digest": {"algorithm": ["none"]}}, {"digest": {"algorithm": "none"}}]}]),
    "names": changed(**{"a.b": {"iids": 1}, "": {"eid": 2}, "x[0]": 3}),
    "list": [1, {"eid": 3}],
    "scalar": 5,
}
BROKEN = {"broken": "{'a", "empty": "", "none": None}


def plain(doc):
    out = set()
    if not isinstance(doc, dict):
        out.add(("no object", ""))
    else:
        out |= {("missing", k) for k in RULES["required"] if k not in doc}
        out |= {("not false", k) for k in RULES["must_be_false"] if doc.get(k) is not False}
        out |= {("not as declared", k) for k, v in RULES["constants"].items() if doc.get(k) != v}

    def walk(node, path):
        items = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ()
        for key, value in items:
            own = f"{path}[{key}]" if isinstance(node, list) else f"{path}.{key}" if path else key
            if isinstance(node, dict):
                if key in inventory.FORBIDDEN:
                    out.add(("forbidden key", own))
                if key == "algorithm" and not (isinstance(value, str) and value in inventory.ALGORITHMS):
                    out.add(("unknown algorithm", own))
                if isinstance(value, list) and len(value) > RULES["longest_list"] and all(isinstance(x, str) for x in value):
                    out.add(("long text list", own))
            walk(value, own)

    walk(doc, "")
    return out


def test_violations_are_those_of_a_recursive_walk(spark):
    rows = [(k, json.dumps(v), 1) for k, v in DOCS.items()] + [(k, v, 1) for k, v in BROKEN.items()]
    df = spark.createDataFrame(rows, "name string, body string, value int")
    got = {(r.id, r.problem, r.path) for r in inventory.violations(df, "name", "body", **RULES).collect()}
    want = {(k, *p) for k, v in DOCS.items() for p in plain(v)} | {(k, "no object", "") for k in BROKEN}
    assert got == want and not [g for g in got if g[0] == "good"]
    assert inventory.violations(df.where("name = 'x'"), "name", "body", **RULES).collect() == []


def test_deep_documents(spark):
    text = '{"a":' * 7 + '{"eid":1}' + "}" * 12
    got = inventory.violations(spark.createDataFrame([("d", text)], "name string, body string"), "name", "body").collect()
    assert [(r.problem, r.path) for r in got] == [("forbidden key", ".".join(["a"] * 7 + ["eid"]))]


def plain_fingerprint(data, whole, window):
    if len(data) <= whole:
        return "sha256_full", hashlib.sha256(data).hexdigest(), True
    return "sha256_head_tail_size", hashlib.sha256(str(len(data)).encode() + data[:window] + (data[max(len(data) - window, window) :] if len(data) > window else b"")).hexdigest(), False


@pytest.mark.parametrize(("whole", "window"), [(1 << 20, 10), (50, 20), (50, 80), (0, 100), (99, 50)])
def test_fingerprints(spark, tmp_path, whole, window):
    sizes = [0, 1, 49, 50, 51, 79, 80, 81, 100, 159, 160, 161, 5000]
    (tmp_path / "sub").mkdir()
    content = {}
    for n in sizes:
        path = tmp_path / ("sub" if n % 2 else ".") / f"f{n} x"
        content[f"f{n} x"] = bytes(i * 7 % 251 for i in range(n))
        path.write_bytes(content[f"f{n} x"])
    rows = fingerprints.fingerprints(spark, str(tmp_path), whole, window).collect()
    assert {os.path.basename(r.path): (r.algorithm, r.value, r.covers_whole_file, r.error) for r in rows} == {k: (*plain_fingerprint(v, whole, window), None) for k, v in content.items()}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    size, window = (2 << 30) + 12_345, 1 << 20
    with open(tmp_path / "large", "wb") as f:
        f.write(b"head")
        f.seek(size - 4)
        f.write(b"tail")
    (row,) = fingerprints.fingerprints(spark, str(tmp_path), window=window).collect()
    zeros = bytes(window)
    assert row.bytes == size and not row.covers_whole_file
    assert row.value == hashlib.sha256(str(size).encode() + b"head" + zeros[4:] + zeros[4:] + b"tail").hexdigest()
    (full,) = fingerprints.fingerprints(spark, str(tmp_path), whole=size).collect()
    digest, left = hashlib.sha256(b"head"), size - 8
    while left:
        digest.update(zeros[: min(left, window)])
        left -= min(left, window)
    digest.update(b"tail")
    assert (full.algorithm, full.value) == ("sha256_full", digest.hexdigest())
    assert max(map(len, fingerprints.pieces(str(tmp_path / "large"), 0, 5 << 20))) == fingerprints.PIECE


def test_a_file_that_changed(spark, tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"abc")
    df = fingerprints.listed(spark, str(tmp_path))
    assert [(r.bytes) for r in df.collect()] == [3] and fingerprints.fingerprint(str(path), 3)[2]

"""SAS files of both widths and byte orders, plain and compressed, built here and read also by pandas."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
import pytest

from tessera.sources import sas

PAGE, START = 4096, 1024


def by_runs(row: bytes) -> bytes:
    """Fills where four or more bytes repeat, copies elsewhere; every kind of command that the lengths allow."""
    out, i = bytearray(), 0
    while i < len(row):
        n = 1
        while i + n < len(row) and row[i + n] == row[i]:
            n += 1
        if n >= 4:
            kind = {0x20: (0x60, 0xE0), 0x00: (0x70, 0xF0), 0x40: (None, 0xD0)}.get(row[i])
            if kind and n <= 17:
                out.append(kind[1] | n - 2)
            elif kind and kind[0]:
                out += bytes([kind[0] | (n - 17) >> 8, (n - 17) & 255])
            elif n <= 18:
                out += bytes([0xC0 | n - 3, row[i]])
            else:
                out += bytes([0x40 | (n - 18) >> 8, (n - 18) & 255, row[i]])
            i += n
            continue
        end = i
        while end < len(row) and not (end + 3 < len(row) and len(set(row[end : end + 4])) == 1) and end - i < 300:
            end += 1
        n = end - i
        if n <= 64:
            out.append((0x80, 0x90, 0xA0, 0xB0)[(n - 1) // 16] | (n - 1) % 16)
        else:
            out += bytes([(n - 64) >> 8, (n - 64) & 255])
        out += row[i:end]
        i = end
    return bytes(out)


def by_references(row: bytes) -> bytes:
    """Sixteen items behind each word of flags: bytes, fills, and copies of what came before."""
    items, i = [], 0
    while i < len(row):
        n = 1
        while i + n < len(row) and row[i + n] == row[i] and n < 4000:
            n += 1
        if n >= 3:
            items.append(bytes([n - 3, row[i]]) if n <= 18 else bytes([0x10 | (n - 19) & 15, (n - 19) >> 4, row[i]]))
            i += n
            continue
        best = (0, 0)
        for back in range(3, min(i, 4000) + 1):
            k = 0
            while k < min(back, 271) and i + k < len(row) and row[i + k] == row[i - back + k]:
                k += 1
            best = max(best, (k, back))
        k, back = best
        if k >= 3:
            low, high = (back - 3) & 15, (back - 3) >> 4
            items.append(bytes([k << 4 | low, high]) if k < 16 else bytes([0x20 | low, high, k - 16]))
            i += k
        else:
            items.append(row[i : i + 1])
            i += 1
    out = bytearray()
    for lo in range(0, len(items), 16):
        group = items[lo : lo + 16]
        out += sum((len(x) > 1) << 15 - k for k, x in enumerate(group)).to_bytes(2, "big") + b"".join(group)
    return bytes(out)


def build(path, columns, rows, wide=False, order="<", compression=b"", mixed=False):
    """columns: (name, size, is text). The layout follows public descriptions of the format."""
    word, skip = (8, 32) if wide else (4, 16)
    end = "little" if order == "<" else "big"
    num = lambda value, size: (value % (1 << 8 * size)).to_bytes(size, end)

    def cell(value, size, text):
        if text:
            return value.encode("latin-1").ljust(size, b" ")
        raw = struct.pack(f"{order}d", float("nan") if value is None else value)
        return raw[8 - size :] if order == "<" else raw[:size]

    raw_rows = [b"".join(cell(v, size, text) for v, (_, size, text) in zip(r, columns, strict=True)) for r in rows]
    row_size = sum(size for _, size, _ in columns)
    sign = lambda low: num(low if low in (sas.ROW_SIZE, sas.COLUMN_COUNT) else low - (1 << 32), word)
    put = lambda size, parts: bytes(bytearray(size)[:0]) + _laid(size, parts)
    text = bytearray(num(0, 2) + bytes(26) + compression.ljust(8, b"\0") + bytes(8))
    spots = []
    for name, _, _ in columns:
        spots.append((len(text), len(name)))
        text += name.encode().ljust(-(-len(name) // 4) * 4, b"\0")
    text[:2] = num(len(text), 2)
    n, lcs = len(columns), 682 if wide else 354
    row_header = put(808 if wide else 480, {0: sign(sas.ROW_SIZE), 5 * word: num(row_size, word), 6 * word: num(len(rows), word), 9 * word: num(n, word), 15 * word: num(len(rows) if mixed else 0, word), lcs: num(0, 2)})
    count_header = put(6 * word, {0: sign(sas.COLUMN_COUNT), word: num(n, word)})
    text_header = sign(sas.COLUMN_TEXT) + bytes(text) + bytes(12)
    name_header = put(2 * word + 12 + 8 * n, {0: sign(sas.COLUMN_NAME)} | {word + 8 * (i + 1): num(0, 2) + num(a, 2) + num(k, 2) for i, (a, k) in enumerate(spots)})
    at, places = 0, {0: sign(sas.COLUMN_PLACE)}
    for i, (_, size, is_text) in enumerate(columns):
        places[word + 8 + i * (word + 8)] = num(at, word) + num(size, 4) + num(0, 2) + bytes([2 if is_text else 1])
        at += size
    place_header = put(2 * word + 12 + (word + 8) * n, places)
    label = put(52 if not wide else 64, {0: num(0xFFFFFBFE - (1 << 32), word)})
    meta = [(h, 0, 0) for h in (row_header, count_header, text_header, name_header, place_header, *[label] * n)]

    def page(kind, headers, plain=()):
        out, tail = bytearray(PAGE), PAGE
        for i, (h, how, own) in enumerate(headers):
            tail -= len(h)
            out[tail : tail + len(h)] = h
            spot = skip + 8 + 3 * word * i
            out[spot : spot + 2 * word + 2] = num(tail, word) + num(len(h), word) + bytes([how, own])
        first = skip + 8 + 3 * word * len(headers)
        first += first % 8 if headers else 0
        body = b"".join(plain)
        assert first + len(body) <= tail
        out[first : first + len(body)] = body
        out[skip : skip + 6] = num(kind, 2) + num(len(headers) + len(plain), 2) + num(len(headers), 2)
        return bytes(out)

    if compression:
        squeeze = by_runs if compression == sas.RUNS else by_references
        pages, own, room = [page(0, meta)], [], PAGE - skip - 8
        for r in raw_rows:
            small = squeeze(r)
            small = small if len(small) < row_size else r
            need = len(small) + 3 * word
            if need > room:
                pages.append(page(0, own))
                own, room = [], PAGE - skip - 8
            own.append((small, 4 if len(small) < row_size else 0, 1))
            room -= need
        pages.append(page(0, own))
    elif mixed:
        pages = [page(sas.MIX, meta, raw_rows)]
    else:
        per = (PAGE - skip - 8) // row_size
        pages = [page(0, meta)] + [page(sas.DATA, [], raw_rows[i : i + per]) for i in range(0, len(rows), per)]
    head = bytearray(START)
    head[:32] = sas.SAS_MAGIC
    shift = 4 if wide else 0
    head[32:33], head[35:36] = (b"3", b"3") if wide else (b"2", b"2")
    head[37], head[39:40], head[70] = 1 if order == "<" else 0, b"1", 29
    head[84:92] = b"SAS FILE"
    head[92:96] = b"TEST"
    head[156:160] = b"DATA"
    for k in (164, 172):
        head[k + shift : k + shift + 8] = struct.pack(f"{order}d", 1e9)
    head[196 + shift : 204 + shift] = num(START, 4) + num(PAGE, 4)
    head[204 + shift : 208 + shift] = num(len(pages), 4)
    path.write_bytes(bytes(head) + b"".join(pages))
    return str(path)


def _laid(size, parts):
    out = bytearray(size)
    for at, piece in parts.items():
        out[at : at + len(piece)] = piece
    return bytes(out)


COLUMNS = [("eid", 8, False), ("name", 40, True), ("short", 3, False), ("note_text", 120, True), ("y", 8, False)]


def table(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["", "a", "abcabcabcabc", "x" * 40, "été", "@@@@@@", "aa  bb"]
    return [[float(i), words[i % 7], float(rng.integers(0, 50)), " ".join(rng.choice(words, 4))[:118].rstrip(), None if i % 11 == 5 else float(rng.normal())] for i in range(n)]


CASES = [(w, o, c) for w in (False, True) for o in "<>" for c in (b"", sas.RUNS, sas.REFERENCES)]


@pytest.mark.parametrize(("wide", "order", "compression"), CASES)
def test_against_pandas_and_the_rows(spark, tmp_path, wide, order, compression):
    rows = table(203)
    path = build(tmp_path / "t.sas7bdat", COLUMNS, rows, wide, order, compression)
    single = sas.read_sas(spark, path)
    assert single.columns == [c[0] for c in COLUMNS] and single.dtypes[1][1] == "string" and single.dtypes[0][1] == "double"
    got = sorted(map(tuple, single.collect()))
    assert got == sorted(map(tuple, rows))
    chunked = sas.read_sas(spark, path, pages=2)
    assert sorted(map(tuple, chunked.collect())) == got and chunked.rdd.getNumPartitions() > 1
    frame = pd.read_sas(io.BytesIO(open(path, "rb").read()), format="sas7bdat", encoding="latin-1")
    assert list(frame.columns) == single.columns and frame["eid"].tolist() == [r[0] for r in rows]
    assert frame["note_text"].fillna("").tolist() == [r[3] for r in rows]
    assert np.allclose(frame["y"].to_numpy(float), np.array([np.nan if r[4] is None else r[4] for r in rows]), equal_nan=True)


@pytest.mark.parametrize("compression", [b"", sas.RUNS, sas.REFERENCES])
def test_limits_and_asked_columns(spark, tmp_path, compression, monkeypatch):
    rows = table(150)
    path = build(tmp_path / "t.sas7bdat", COLUMNS, rows, True, "<", compression)
    for limit in (0, 1, 20, 149, 150, 1000):
        for pages in (1, 3, 1024):
            got = sas.read_sas(spark, path, ["y", "eid"], rows=limit, pages=pages).collect()
            assert sorted(r.eid for r in got) == [float(i) for i in range(min(limit, 150))], (limit, pages)
    assert [tuple(r) for r in got[:1]] == [(rows[int(got[0].eid)][4], got[0].eid)]
    head = sas.read_sas_head(path)
    asked = [c for c in head.columns if c.name == "short"]
    decoded = []
    monkeypatch.setattr(sas.SasHead, "decode", lambda self, found, c, old=sas.SasHead.decode: decoded.append(c.name) or old(self, found, c))
    reader = sas.SasReader({"path": path, "pages": "1"}, head, asked)
    values = [v for part in reader.partitions() for batch in reader.read(part) for v in batch.column(0).to_pylist()]
    assert values == [r[2] for r in rows] and set(decoded) == {"short"}
    with pytest.raises(Exception, match="not in the file"):
        sas.read_sas(spark, path, ["eid", "nope"]).collect()


def test_rows_beside_metadata_and_broken_files(spark, tmp_path):
    rows = table(8)
    path = build(tmp_path / "m.sas7bdat", COLUMNS, rows, mixed=True)
    assert sorted(map(tuple, sas.read_sas(spark, path).collect())) == sorted(map(tuple, rows))
    none = build(tmp_path / "n.sas7bdat", COLUMNS, [])
    assert sas.read_sas(spark, none).collect() == []
    (tmp_path / "bad").write_bytes(b"x" * 5000)
    with pytest.raises(Exception, match="not a SAS7BDAT"):
        sas.read_sas(spark, str(tmp_path / "bad"))


@pytest.mark.parametrize(("squeeze", "expand"), [(by_runs, sas.expand_runs), (by_references, sas.expand_references)])
def test_compressions_read_back(squeeze, expand):
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 17, 64, 65, 300, 5000):
        for kinds in (1, 2, 256):
            row = np.repeat(rng.choice([0, 32, 64, *rng.integers(0, 256, kinds)], size), rng.integers(1, 5, size))[:size].astype(np.uint8).tobytes()
            assert expand(squeeze(row), len(row)) == row
    assert expand(squeeze(b" " * 4000), 4000) == b" " * 4000
    with pytest.raises(ValueError, match="a row of"):
        expand(squeeze(b"abcdef"), 9)

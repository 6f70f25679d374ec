"""SAS7BDAT files: a Python data source over ranges of pages.

The driver reads the metadata pages at the file's beginning; a partition is a
range of pages, of which each task reads its own. Only the asked columns are
decoded, whole pages at a time in numpy where rows are stored plainly; rows of
compressed files are expanded one by one, by run lengths or by back references.
Numbers that are missing are null, texts lose their padding. The path must be
one that executors can open.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The file's first bytes, the page kinds, the compression names and the text encodings by number (fixed format).
SAS_MAGIC = bytes(12) + bytes.fromhex("c2ea8160b31411cfbd92080009c7318c181f1011")
META, DATA, MIX, AMENDED = (0x0000, 0x4000), 0x0100, 0x0200, 0x0400
KIND_BITS = 0xFF00
RUNS, REFERENCES = b"SASYZCRL", b"SASYZCR2"
ENCODINGS = {20: "utf-8", 28: "ascii", 29: "latin-1", 60: "cp1250", 61: "cp1251", 62: "cp1252"}
#: Subheaders by the low 32 bits of their signature (fixed format).
ROW_SIZE, COLUMN_COUNT, COLUMN_TEXT, COLUMN_NAME, COLUMN_PLACE = 0xF7F7F7F7, 0xF6F6F6F6, 0xFFFFFFFD, 0xFFFFFFFF, 0xFFFFFFFC
#: Bytes of pages that a task decodes at a time.
STEP_BYTES = 8 << 20


def expand_runs(data: bytes, size: int) -> bytes:
    """Run-length compression: the high half of each control byte names a fill or a copy, the low half adds to its length."""
    out, i = bytearray(), 0
    while i < len(data):
        control, low = data[i] & 0xF0, data[i] & 0x0F
        i += 1
        if control in (0x00, 0x40, 0x60, 0x70):
            n = low * 256 + data[i] + {0x00: 64, 0x40: 18, 0x60: 17, 0x70: 17}[control]
            i += 1
        else:
            n = low + {0x80: 1, 0x90: 17, 0xA0: 33, 0xB0: 49, 0xC0: 3, 0xD0: 2, 0xE0: 2, 0xF0: 2}.get(control, -16)
            if n < 0:
                raise ValueError(f"control byte {control:#x}")
        if control == 0x00 or 0x80 <= control <= 0xB0:
            out += data[i : i + n]
            i += n
        elif control in (0x40, 0xC0):
            out += data[i : i + 1] * n
            i += 1
        else:
            out += {0x60: b" ", 0x70: b"\0", 0xD0: b"@", 0xE0: b" ", 0xF0: b"\0"}[control] * n
    return _sized(out, size)


def expand_references(data: bytes, size: int) -> bytes:
    """Compression by references to earlier output: sixteen flags, then as many bytes or commands."""
    out, i, flags, left = bytearray(), 0, 0, 0
    while i < len(data):
        if not left:
            flags, left, i = int.from_bytes(data[i : i + 2], "big"), 16, i + 2
            continue
        left -= 1
        if not flags >> left & 1:
            out.append(data[i])
            i += 1
            continue
        command, n = data[i] >> 4, data[i] & 15
        i += 1
        if command == 0:
            out += data[i : i + 1] * (n + 3)
            i += 1
        elif command == 1:
            out += data[i + 1 : i + 2] * (n + (data[i] << 4) + 19)
            i += 2
        else:
            back = n + 3 + (data[i] << 4)
            i += 1
            if command == 2:
                command = data[i] + 16
                i += 1
            if back > len(out):
                raise ValueError("a reference before the row")
            for _ in range(command):
                out.append(out[-back])
    return _sized(out, size)


def _sized(out: bytearray, size: int) -> bytes:
    if len(out) != size:
        raise ValueError(f"a row of {len(out)} bytes, not {size}")
    return bytes(out)


@dataclass
class SasColumn:
    name: str
    text: bool
    offset: int
    size: int


@dataclass
class SasHead:
    wide: bool
    order: str
    encoding: str
    start: int
    page_size: int
    pages: int
    row_size: int = 0
    rows: int = 0
    mixed_rows: int = 0
    compression: bytes = b""
    columns: list[SasColumn] = field(default_factory=list)

    def number(self, data: bytes, at: int, size: int) -> int:
        return int.from_bytes(data[at : at + size], "little" if self.order == "<" else "big")

    @property
    def word(self) -> int:
        return 8 if self.wide else 4

    @property
    def skip(self) -> int:
        """Bytes of a page before its kind and counts."""
        return 32 if self.wide else 16

    def page(self, data: bytes) -> tuple[int, int, list[tuple[int, int, int, int]]]:
        """Kind, rows, and (offset, size, compression, kind) of each subheader."""
        kind, blocks, n = (self.number(data, self.skip + k, 2) for k in (0, 2, 4))
        found = []
        for i in range(n):
            at = self.skip + 8 + i * 3 * self.word
            found.append((self.number(data, at, self.word), self.number(data, at + self.word, self.word), data[at + 2 * self.word], data[at + 2 * self.word + 1]))
        return kind & KIND_BITS, blocks, found

    def data_rows(self, data: bytes) -> tuple[np.ndarray | None, list[tuple[int, int]]]:
        """A page's plainly stored rows, or the places of those that are subheaders."""
        kind, blocks, found = self.page(data)
        if kind in (DATA, MIX):
            n = blocks if kind == DATA else min(self.rows, self.mixed_rows)
            at = self.skip + 8
            if kind == MIX:
                at += len(found) * 3 * self.word
                at += at % 8
            if at + n * self.row_size > len(data):
                raise ValueError("a page's rows do not fit it")
            return np.frombuffer(data, np.uint8, n * self.row_size, at).reshape(n, self.row_size), []
        return None, [(a, size) for a, size, compression, own in found if self.compression and own == 1 and compression in (0, 4) and size]

    def row_count(self, data: bytes) -> int:
        plain, places = self.data_rows(data)
        return len(places) if plain is None else len(plain)

    def rows_of(self, data: bytes) -> np.ndarray:
        plain, places = self.data_rows(data)
        if plain is not None:
            return plain
        expand = expand_runs if self.compression == RUNS else expand_references
        rows = [data[a : a + size] if size >= self.row_size else expand(data[a : a + size], self.row_size) for a, size in places]
        return np.frombuffer(b"".join(r[: self.row_size] for r in rows), np.uint8).reshape(len(rows), self.row_size)

    def decode(self, rows: np.ndarray, column: SasColumn) -> pa.Array:
        raw = rows[:, column.offset : column.offset + column.size]
        if column.text:
            texts = [t.tobytes().rstrip(b"\0 ").decode(self.encoding, "replace") for t in np.ascontiguousarray(raw)]
            return pa.array(texts, pa.string())
        full = np.zeros((len(rows), 8), np.uint8)  # short numbers keep their high bytes
        if self.order == "<":
            full[:, 8 - column.size :] = raw
        else:
            full[:, : column.size] = raw
        values = full.view(f"{self.order}f8").ravel().astype(np.float64)
        return pa.array(values, pa.float64(), mask=np.isnan(values))


def read_sas_head(path: str, encoding: str | None = None) -> SasHead:
    with open(path, "rb") as f:
        first = f.read(288)
        if len(first) < 288 or first[:32] != SAS_MAGIC:
            raise ValueError("not a SAS7BDAT file")
        wide, shift, order = first[32:33] == b"3", 4 * (first[35:36] == b"3"), "<" if first[37] == 1 else ">"
        head = SasHead(wide, order, encoding or ENCODINGS.get(first[70], "latin-1"), 0, 0, 0)
        head.start, head.page_size = head.number(first, 196 + shift, 4), head.number(first, 200 + shift, 4)
        if head.page_size < 64 or head.start < 288:
            raise ValueError("no page size")
        head.pages = (os.path.getsize(path) - head.start) // head.page_size
        f.seek(head.start)
        texts: list[bytes] = []
        names: list[str] = []
        places: list[tuple[int, int, bool]] = []
        for _ in range(head.pages):
            page = f.read(head.page_size)
            if _metadata(head, page, texts, names, places):
                break
    if len(names) != len(places) or not head.row_size:
        raise ValueError(f"{len(names)} names and {len(places)} places of columns")
    head.columns = [SasColumn(n, text, at, size) for n, (at, size, text) in zip(names, places, strict=True)]
    return head


def _metadata(head: SasHead, page: bytes, texts: list[bytes], names: list[str], places: list[tuple[int, int, bool]]) -> bool:
    """Read a page's subheaders; whether it holds rows, behind which no column is described."""
    kind, _, found = head.page(page)
    if kind == DATA:
        return True
    word = head.word
    for at, size, compression, own in found:
        if not size or compression == 1:  # cut off
            continue
        signature = head.number(page, at, word)
        if word == 8:  # wide files widen the small signatures by sign; big-endian ones may keep theirs in the first half
            signature = signature & 0xFFFFFFFF if head.order == "<" or signature >> 32 in (0, 0xFFFFFFFF) else signature >> 32
        if signature == ROW_SIZE:
            head.row_size, head.rows, head.mixed_rows = (head.number(page, at + k * word, word) for k in (5, 6, 15))
        elif signature == COLUMN_TEXT:
            block = page[at + word : at + word + head.number(page, at + word, 2)]
            if not texts:
                head.compression = next((c for c in (RUNS, REFERENCES) if c in block), b"")
            texts.append(block)
        elif signature == COLUMN_NAME and own != 1:
            for i in range((size - 2 * word - 12) // 8):
                which, where, n = (head.number(page, at + word + 8 * (i + 1) + k, 2) for k in (0, 2, 4))
                names.append(texts[which][where : where + n].decode(head.encoding, "replace"))
        elif signature == COLUMN_PLACE and own != 1:
            for i in range((size - 2 * word - 12) // (word + 8)):
                entry = at + word + 8 + i * (word + 8)
                places.append((head.number(page, entry, word), head.number(page, entry + word, 4), page[entry + word + 6] == 2))
    return kind == MIX or bool(head.compression and any(own == 1 and size for _, size, _, own in found))


class _Pages(InputPartition):
    def __init__(self, first: int, stop: int, most: int | None):
        self.first, self.stop, self.most = first, stop, most


class SasReader(DataSourceReader):
    def __init__(self, options: dict, head: SasHead, columns: list[SasColumn]):
        self.path, self.head, self.columns = options["path"], head, columns
        self.step = max(1, int(options.get("pages", 1024)))
        self.limit = int(options["rows"]) if "rows" in options else None

    def partitions(self) -> list[InputPartition]:
        """Ranges of pages; with a limit, up to the page that reaches it, whose counts are read one after the other."""
        if self.limit is None:
            return [_Pages(lo, min(lo + self.step, self.head.pages), None) for lo in range(0, self.head.pages, self.step)]
        out, left = [], self.limit
        with open(self.path, "rb") as f:
            for lo in range(0, self.head.pages, self.step):
                own = 0
                f.seek(self.head.start + lo * self.head.page_size)
                for _ in range(lo, min(lo + self.step, self.head.pages)):
                    own += self.head.row_count(f.read(self.head.page_size))
                    if own >= left:
                        break
                if left > 0 and own:
                    out.append(_Pages(lo, min(lo + self.step, self.head.pages), min(own, left)))
                left -= own
                if left <= 0:
                    break
        return out or [_Pages(0, 0, 0)]

    def read(self, part: _Pages) -> Iterator[pa.RecordBatch]:
        size, left = self.head.page_size, part.most
        step = max(1, STEP_BYTES // size)
        with open(self.path, "rb") as f:
            f.seek(self.head.start + part.first * size)
            for lo in range(part.first, part.stop, step):
                found = [self.head.rows_of(f.read(size)) for _ in range(lo, min(lo + step, part.stop))]
                rows = np.concatenate(found)
                if left is not None:
                    rows = rows[:left]
                    left -= len(rows)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([self.head.decode(rows, c) for c in self.columns], [c.name for c in self.columns])
                if left == 0:
                    return


class SasSource(DataSource):
    """spark.read.format("sas7bdat").load(path); options columns (by comma), rows (at most), pages (of a partition), encoding."""

    @classmethod
    def name(cls) -> str:
        return "sas7bdat"

    def _asked(self) -> tuple[SasHead, list[SasColumn]]:
        head = read_sas_head(self.options["path"], self.options.get("encoding"))
        if not self.options.get("columns"):
            return head, head.columns
        known = {c.name: c for c in head.columns}
        asked = self.options["columns"].split(",")
        missing = [n for n in asked if n not in known]
        if missing:
            raise ValueError(f"columns not in the file: {missing}")
        return head, [known[n] for n in asked]

    def schema(self) -> str:
        return ", ".join(f"`{c.name.replace('`', '``')}` {'string' if c.text else 'double'}" for c in self._asked()[1])

    def reader(self, schema) -> SasReader:
        return SasReader(self.options, *self._asked())


def read_sas(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int | None = None, pages: int = 1024, encoding: str | None = None) -> DataFrame:
    """The asked columns of a file, all if none are named; rows is a limit."""
    spark.dataSource.register(SasSource)
    reader = spark.read.format("sas7bdat").option("pages", pages)
    for name, value in (("columns", ",".join(columns or [])), ("rows", rows), ("encoding", encoding)):
        if value is not None and value != "":
            reader = reader.option(name, value)
    return reader.load(path)

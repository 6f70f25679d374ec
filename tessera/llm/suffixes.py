"""Suffix-array dedup: removal of repeated byte strings, by external induced sorting.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier:
in a text with a smaller id, or in the same text at an earlier byte.

Texts are far too large to sort at once, so windows are first dealt into
shards that can be sorted alone. Each window of LENGTH bytes has an anchor,
the leftmost of its ANCHOR-byte strings with the least hash; equal windows
have equal anchors. Neighbouring windows with one anchor form a stretch, and
within a stretch no two windows are equal. Stretches, as hashes of anchor and
content, meet in the anchor's shard, which settles what needs no sorting: an
anchor that occurs once has no repeats, and of equal stretches those beyond the
second are counted before the sort, as copies of the ones that are sorted. All
other stretches, the first two of every content, are fetched from their texts
and dealt by anchor into shards, where `induced.InducedSorter` sorts all
suffixes, with disk-backed queues that carry common-prefix values; in each run
of suffixes that share LENGTH bytes all windows but the earliest are repeats.
So the sorter finds, on the bytes themselves, every repeat of a content that
occurs twice and of different contents that overlap.

A passage in very many texts gives its anchors as many different stretches,
each with other bytes around it. Such a hot anchor's stretches are cut again:
windows whose anchor stands at about the same offset, CLASS offsets together,
form smaller stretches, dealt by the bytes that all these windows hold, so
that a hot anchor spreads over many shards of the same sorter.

The sorter's files are in the shared folder where it is mounted as a local
path, else in the task's own temporary folder; no other task reads them, and
they go when the task ends.

Defined cases: null and empty texts have nothing to remove; texts shorter than
LENGTH neither; texts are handled whole, a very long one as a block of its
own; a null id counts as the smallest; rows that repeat an id with different
texts are ordered by their texts' hashes; rows that repeat id and text are one
document and share its result; an empty table gives an empty result; other
columns are ignored, whatever their names, or carried unchanged where asked
for.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.blocks import BASE_INV, blocks, bounded_batches, mix, powers, prefix_hash, raw_bytes, release, span_hash
from tessera.llm.induced import InducedSorter
from tessera.session import keep, mounted_scratch

LENGTH, ANCHOR = 100, 32
#: Windows looked at together; their positions fit PLACE bits.
PLACE = 24
SEGMENT = 1 << 23
#: Input rows a shard of stretches, and bounds of their number; bytes a sorted shard.
SHARD_ROWS, FEW_SHARDS, MANY_SHARDS = 4_000, 16, 16_384
SORTED_BYTES = 4 << 20
#: Bytes of stretches that a task gathers before it deals them to the shards, so that a shard gets few large pieces.
FETCHED = 32 << 20
#: Tuples that a queue of the sorter holds before it goes to disk.
MEMORY = 1_000_000
#: Stretches of a shard held in memory; beyond this they go to local files by hash, one of which is held at a time.
HELD, FILES = 8_000_000, 32
#: Different stretches of one anchor beyond which they are cut again, and offsets of the anchor in a class.
HOT, CLASS = 100_000, 8
NO_ID = -(1 << 63)
ROWS = "shard int, blob binary"
SPANS = "id bigint, digest bigint, starts array<bigint>, ends array<bigint>"
_U = np.uint64


def stretches(data: np.ndarray, at: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, places: bool = False) -> tuple[np.ndarray, ...]:
    """(text number, first window's byte in the text, windows, anchor hash, content hash[, anchor's place]) of each stretch of a block."""
    prefix = prefix_hash(data)
    found = []
    inverse = powers(len(data), BASE_INV)
    end_of = np.repeat(at[1:], np.diff(at))
    for begin in range(0, max(0, len(data) - length + 1), SEGMENT):
        stop = min(len(data), begin + SEGMENT + length - 1)
        n = stop - begin - anchor + 1
        own = mix((prefix[begin + anchor : stop + 1] - prefix[begin : stop - anchor + 1]) * inverse[begin : begin + n])
        least = (own & ~_U((1 << PLACE) - 1)) | np.arange(n, dtype=_U)
        span, width = length - anchor + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        window = np.arange(len(least)) + begin
        window = window[window + length <= end_of[window]]
        place = (least[window - begin] & _U((1 << PLACE) - 1)).astype(np.int64)
        if not len(window):
            continue
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)]))
        lo, hi = window[first], window[np.append(first[1:], len(window)) - 1]
        text = np.searchsorted(at, lo, "right") - 1
        found.append((text, lo - at[text], hi - lo + 1, own[place[first]], span_hash(prefix, lo, hi + length)) + ((place[first] + begin,) if places else ()))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2 + (np.zeros(0, np.int64),) * places
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)


def _pack(ids: np.ndarray, digests: np.ndarray, text: np.ndarray, *columns: np.ndarray) -> bytes:
    """Entries sorted by text: the texts that occur, entries of each, and the columns."""
    used, count = np.unique(text, return_counts=True)
    return pickle.dumps((ids[used], digests[used], _narrow(count), *columns), protocol=5)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    ids, digests, count, *columns = pickle.loads(blob)
    return np.repeat(ids, count), np.repeat(digests, count), *columns


def _lists(schema_names: list[str], ids: np.ndarray, digests: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row of lists for each text; entries sorted by (id, digest)."""
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (digests[1:] != digests[:-1])])) if len(ids) else np.zeros(0, int)
    offsets = pa.array(np.append(first, len(ids)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(digests[first]), *[pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]], schema_names)


#: By text: stretches that repeat (starts, ends), those that are to be sorted (ASK records) and how many bytes they have, and those of hot anchors (their lo).
FOUND = "id bigint, digest bigint, starts array<bigint>, ends array<bigint>, ask binary, hot binary, bytes bigint"
ASK = np.dtype([("lo", "<u4"), ("n", "<u2"), ("anchor", "<u4")])


def _records(lists: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every record in rows of lists of bytes."""
    flat = lists.flatten()
    size = np.diff(np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]) if len(flat) else np.zeros(0, int)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return np.repeat(row, size // kind.itemsize), np.frombuffer(b"".join(flat.to_pylist()), kind)


def _by_text(records: np.ndarray, count: np.ndarray) -> pa.Array:
    """The records' bytes, as many for each text as counted."""
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32) * records.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(records.tobytes())])


def cut_again(part: pa.RecordBatch, data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The stretches that a row names in hot_lo and hot_n, cut into classes of the anchor's offset.

    As `stretches`, with the hash of the bytes that all windows of the class hold in place of the anchor's.
    """
    owner, asked_lo = _records(part.column(part.schema.get_field_index("hot")), np.dtype("<u4"))
    wanted = at[owner] + asked_lo.astype(np.int64)
    anchor = min(ANCHOR, length)
    text, lo, n, _, _, place = stretches(data, at, length, anchor, places=True)
    mine = np.flatnonzero(np.isin(at[text] + lo, wanted))
    text, first, n, place = text[mine], at[text[mine]] + lo[mine], n[mine], place[mine]
    # offsets of the anchor in the stretch's windows run from place - first down to place - (first + n - 1)
    most, least = (place - first) // CLASS, (place - first - n + 1) // CLASS
    classes = most - least + 1
    one = np.repeat(np.arange(len(mine)), classes)
    kind = most[one] - (np.arange(len(one)) - np.repeat(np.cumsum(classes) - classes, classes))
    begin = np.maximum(first[one], place[one] - kind * CLASS - CLASS + 1)
    end = np.minimum(first[one] + n[one] - 1, place[one] - kind * CLASS)
    prefix = prefix_hash(data)
    core_from = place[one] - kind * CLASS
    core_to = np.maximum(core_from, place[one] - kind * CLASS - CLASS + 1 + length)
    core = mix(span_hash(prefix, core_from, core_to) ^ (kind.astype(_U) + _U(1)))
    return text[one], begin - at[text[one]], end - begin + 1, core, span_hash(prefix, begin, end + length)


def _seconds(other: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Which of the stretches that are not the first of their content come second. Stretches stand by content; lead is the first of each."""
    passed = np.cumsum(other)
    return other & (passed - passed[lead] == 1)


def _settle(ids, digests, lo, n, anchor, content, length: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Copies beyond the second, and what is to be sorted, of the stretches of some anchors."""
    if not len(ids):
        return
    order = np.lexsort((lo, digests, ids, content, anchor))
    ids, digests, lo, n, anchor, content = (x[order] for x in (ids, digests, lo, n, anchor, content))
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new = new_anchor | np.concatenate([[True], content[1:] != content[:-1]])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    itself = (ids == ids[lead]) & (digests == digests[lead]) & (lo == lo[lead])
    group = np.cumsum(new_anchor) - 1
    contents = np.bincount(group, new)[group]
    second = _seconds(~itself, lead)
    copied = np.bincount(np.cumsum(new) - 1, second)[np.cumsum(new) - 1] > 0
    needed = second | (new & (copied | (contents > 1)))
    repeat, ask, much = ~itself & ~second, needed & (contents <= hot), needed & (contents > hot)
    some = np.flatnonzero(repeat | ask | much)
    if not len(some):
        return
    some = some[np.lexsort((lo[some], digests[some], ids[some]))]
    text = np.cumsum(np.concatenate([[True], (ids[some][1:] != ids[some][:-1]) | (digests[some][1:] != digests[some][:-1])])) - 1
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    count = lambda mask: np.bincount(text[mask], minlength=len(first))
    again, asked, hot_ones = repeat[some], ask[some], much[some]
    offsets = pa.array(np.concatenate([[0], np.cumsum(count(again))]).astype(np.int32))
    spans = [pa.ListArray.from_arrays(offsets, pa.array(v[some][again].astype(np.int64))) for v in (lo, lo + n + length - 1)]
    records = np.zeros(int(asked.sum()), ASK)
    records["lo"], records["n"], records["anchor"] = lo[some][asked], n[some][asked], mix(anchor[some][asked]) >> _U(32)
    size = np.bincount(text[asked], n[some][asked] + length, len(first)).astype(np.int64)
    columns = [*spans, _by_text(records, count(asked)), _by_text(lo[some][hot_ones].astype("<u4"), count(hot_ones)), pa.array(size)]
    yield pa.RecordBatch.from_arrays([pa.array(ids[some][first]), pa.array(digests[some][first]), *columns], ["id", "digest", "starts", "ends", "ask", "hot", "bytes"])


class _Held:
    """Stretches of one shard; beyond HELD in files by anchor hash."""

    def __init__(self, most: int):
        self.most, self.parts, self.count, self.folder, self.files = most, [], 0, None, 0

    def add(self, entry: tuple) -> None:
        self.parts.append(entry)
        self.count += len(entry[0])
        if self.count > self.most:
            self.folder = self.folder or tempfile.mkdtemp(prefix="stretches-")
            joined = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            to = (joined[4] >> _U(20)) % _U(FILES)
            for k in range(FILES):
                with open(os.path.join(self.folder, f"{k}-{self.files}"), "wb") as f:
                    pickle.dump(tuple(x[to == k] for x in joined), f, protocol=5)
            self.files += 1
            self.parts, self.count = [], 0

    def groups(self) -> Iterator[tuple]:
        if self.folder is None:
            if self.parts:
                yield tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))
            return
        try:
            for k in range(FILES):
                parts = [tuple(x[(p[4] >> _U(20)) % _U(FILES) == k] for x in p) for p in self.parts]
                for n in range(self.files):
                    with open(os.path.join(self.folder, f"{k}-{n}"), "rb") as f:
                        parts.append(pickle.load(f))
                yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)


def find_stretches(docs: DataFrame, shards: int, length: int, held: int = HELD, hot: int = HOT, again_cut: bool = False) -> DataFrame:
    """FOUND rows from docs (id, digest, text); with again_cut of the stretches that docs names, cut again, else of all."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in blocks(batches):
            ids, digests = part.column(0).to_numpy(), part.column(1).to_numpy()
            text, lo, n, anchor, content = cut_again(part, data, at, length) if again_cut else stretches(data, at, length, min(ANCHOR, length))
            if not len(text):
                continue
            # equal stretches of one block: those beyond the second are copies already, and need not travel as hashes
            rank = np.empty(len(ids), np.int64)
            rank[np.lexsort((digests, ids))] = np.arange(len(ids))
            order = np.lexsort((lo, rank[text], content, anchor))
            new = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (content[order][1:] != content[order][:-1])])
            lead = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            other = ~new & ~((ids[text[order]] == ids[text[lead]]) & (digests[text[order]] == digests[text[lead]]) & (lo[order] == lo[lead]))
            second = _seconds(other, np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)))
            again = order[other & ~second]
            rows = []
            if len(again):
                again = again[np.lexsort((lo[again], text[again]))]
                rows.append((int(rank[0]) % shards, pickle.dumps((True, _pack(ids, digests, text[again], _narrow(lo[again]), _narrow(n[again]))), protocol=5)))
            first = np.sort(order[new | second])
            shard = (mix(anchor[first]) % _U(shards)).astype(np.int64)
            by = first[np.argsort(shard, kind="stable")]
            cut = np.searchsorted(np.sort(shard, kind="stable"), np.arange(shards + 1))
            for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:
                    k = by[a:b]
                    rows.append((s, pickle.dumps((False, _pack(ids, digests, text[k], _narrow(lo[k]), _narrow(n[k]), anchor[k], content[k])), protocol=5)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now:
                    if own is not None:
                        for group in own.groups():
                            yield from _settle(*group, length, hot)
                        release()
                    now, own = shard, _Held(held)
                known, packed = pickle.loads(blob.as_py())
                if known:
                    ids, digests, lo, n = _unpack(packed)
                    order = np.lexsort((digests, ids))
                    ids, digests, lo, n = ids[order], digests[order], lo[order].astype(np.int64), n[order].astype(np.int64)
                    found = _lists(["id", "digest", "starts", "ends"], ids, digests, lo, lo + n + length - 1)
                    empty = pa.array([b""] * found.num_rows, pa.binary())
                    yield pa.RecordBatch.from_arrays([*found.columns, empty, empty, pa.array([0] * found.num_rows, pa.int64())], [*found.schema.names, "ask", "hot", "bytes"])
                else:
                    ids, digests, lo, n, anchor, content = _unpack(packed)
                    own.add((ids, digests, lo.astype(np.int64), n.astype(np.int64), anchor, content))
        if own is not None:
            for group in own.groups():
                yield from _settle(*group, length, hot)

    sent = docs.select("id", "digest", "text", *["hot"] * again_cut).mapInArrow(deal, ROWS)
    return sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(meet, FOUND)


def repeated_windows(contents: np.ndarray, starts: np.ndarray, n: np.ndarray, key: np.ndarray, length: int, sorter: InducedSorter) -> tuple[np.ndarray, np.ndarray]:
    """(entry, offset) of each window that repeats one of smaller key + offset.

    contents: all entries' bytes plus 1, each entry followed by 255, all by 0; starts: where each entry
    begins; n: windows of each entry; key: order of each entry's first byte.
    """
    entry_out, offset_out = [], []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    # entries are longer than 1 << coarse bytes, so that so many bytes meet two of them at most
    coarse = max(0, int(n.min()) + length - 1).bit_length() - 1
    begins = np.append(starts, len(contents))
    entry_at = np.maximum(0, np.searchsorted(starts, np.arange(0, len(contents), 1 << coarse), "right") - 1).astype(np.int32)

    def close(entry: np.ndarray, offset: np.ndarray, group: np.ndarray) -> None:
        if not len(entry):
            return
        place = key[entry] + offset
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(place, first)
        again = place != np.repeat(least, np.diff(np.append(first, len(group))))
        entry_out.append(entry[again])
        offset_out.append(offset[again])

    def members(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entry = entry_at[pos >> coarse]
        entry = entry + (begins[entry + 1] <= pos)
        entry[entry == len(starts)] = 0
        offset = pos - starts[entry]
        real = offset < n[entry]
        return entry, offset, real

    for pos, common in sorter.descending(contents, length):
        group = np.cumsum(common < length)
        entry, offset, real = members(pos)
        # the group that is open from chunks before, then whole groups, then the one that stays open
        if held and group[0] == 0:
            held.append((entry[real & (group == 0)], offset[real & (group == 0)]))
        if group[-1] == 0 and held:
            continue
        if held:
            e, o = (np.concatenate(x) for x in zip(*held, strict=True))
            close(e, o, np.zeros(len(e), int))
        whole = real & (group < group[-1]) & (group > 0)
        close(entry[whole], offset[whole], group[whole])
        if not held and group[0] == 0 and group[-1] > 0:
            start = real & (group == 0)
            close(entry[start], offset[start], group[start])
        last = real & (group == group[-1])
        held = [(entry[last], offset[last])]
    if held:
        e, o = (np.concatenate(x) for x in zip(*held, strict=True))
        close(e, o, np.zeros(len(e), int))
    if not entry_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(entry_out), np.concatenate(offset_out)


def sort_stretches(docs: DataFrame, asked: DataFrame, shards: int, length: int, memory: int, fetched: int = FETCHED) -> DataFrame:
    """SPANS rows: the windows that repeat among the stretches that are to be sorted."""

    def dealt(ids: np.ndarray, digests: np.ndarray, text: np.ndarray, lo: np.ndarray, n: np.ndarray, shard: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        """Stretches in the order of their texts, one row for each shard; data holds their bytes one after the other."""
        span = n + length - 1
        begin = np.cumsum(span) - span
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], shard[order][1:] != shard[order][:-1]]))
        blobs = []
        for k in np.split(order, cut[1:]):
            place = np.repeat(begin[k] - (np.cumsum(span[k]) - span[k]), span[k]) + np.arange(span[k].sum())
            blobs.append(_pack(ids, digests, text[k], _narrow(lo[k]), n[k].astype(np.uint16), pa.compress(data[place].tobytes(), "zstd", asbytes=True)))
        return pa.RecordBatch.from_arrays([pa.array(shard[order][cut], pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], 0, 0
        for part, data, at in blocks(batches):
            text, records = _records(part.column(part.schema.get_field_index("ask")), ASK)
            order = np.lexsort((records["lo"], text))
            text, lo, n = text[order], records["lo"][order].astype(np.int64), records["n"][order].astype(np.int64)
            shard = (records["anchor"][order] % shards).astype(np.int64)
            span = n + length - 1
            place = np.repeat(at[text] + lo - (np.cumsum(span) - span), span) + np.arange(span.sum())
            held.append((part.column(0).to_numpy().copy(), part.column(1).to_numpy().copy(), text + texts, lo, n, shard, data[place]))
            texts, size = texts + part.num_rows, size + len(place)
            if size > fetched:
                yield dealt(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, texts, size = [], 0, 0
        if size:
            yield dealt(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def finish(parts: list, folder: str) -> Iterator[pa.RecordBatch]:
        ids, digests, lo, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
        rank = np.zeros(len(ids), np.int64)
        by = np.lexsort((digests, ids))
        rank[by] = np.cumsum(np.concatenate([[0], (ids[by][1:] != ids[by][:-1]) | (digests[by][1:] != digests[by][:-1])]))
        span = n + length - 1
        starts = np.cumsum(span + 1) - span - 1
        contents = np.memmap(os.path.join(folder, "text"), np.uint8, "r")
        with InducedSorter(memory, folder=folder, shallow=True) as sorter:
            entry, offset = repeated_windows(contents, starts, n, (rank << 33) + lo, length, sorter)
        del contents
        release()
        if not len(entry):
            return
        window = lo[entry] + offset
        order = np.lexsort((window, rank[entry]))
        entry, window = entry[order], window[order]
        # neighbouring windows of a text as one span
        first = np.flatnonzero(np.concatenate([[True], (rank[entry][1:] != rank[entry][:-1]) | (window[1:] > window[:-1] + 1)]))
        last = np.append(first[1:], len(window)) - 1
        yield _lists(["id", "digest", "starts", "ends"], ids[entry[first]], digests[entry[first]], window[first], window[last] + length)

    def received(file, blob: pa.BinaryScalar) -> tuple[np.ndarray, ...]:
        """Writes a blob's stretches to the shard's text, each byte plus 1 and 255 after each; the rest of it is held."""
        ids, digests, lo, n, data = _unpack(blob.as_py())
        lo, n = lo.astype(np.int64), n.astype(np.int64)
        span = n + length - 1
        data = pa.decompress(data, int(span.sum()), "zstd", asbytes=True)
        text = np.full(int((span + 1).sum()), 255, np.uint8)
        text[np.arange(span.sum()) + np.repeat(np.arange(len(span)), span)] = np.frombuffer(data, np.uint8) + np.uint8(1)
        file.write(text.data)
        return ids, digests, lo, n

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((shard, blob) for batch in batches for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for _, own in groupby(rows, key=lambda r: r[0]):
            folder = tempfile.mkdtemp(prefix="sorted-", dir=shared if shared and os.path.isdir(shared) else None)
            try:
                with open(os.path.join(folder, "text"), "wb") as file:
                    parts = [received(file, blob) for _, blob in own]
                    file.write(b"\0")
                yield from finish(parts, folder)
            finally:
                shutil.rmtree(folder, ignore_errors=True)

    shared = mounted_scratch(docs.sparkSession)
    texts = docs.select("id", "digest", "text").join(asked.hint("shuffle_hash"), ["id", "digest"]).select("id", "digest", "text", "ask")
    return texts.mapInArrow(fetch, ROWS).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(sort, SPANS)


def repeated_spans(docs: DataFrame, length: int = LENGTH, held: int = HELD, sorted_bytes: int = SORTED_BYTES, memory: int = MEMORY, hot: int = HOT, fetched: int = FETCHED) -> DataFrame:
    """SPANS rows, several for a text and overlapping, from docs (id, digest, text)."""
    shards = min(MANY_SHARDS, max(FEW_SHARDS, -(-docs.count() // SHARD_ROWS)))
    found = keep(find_stretches(docs, shards, length, held, hot), "stretches")
    named = lambda rows, column: rows.where(F.octet_length(column) > 0).groupBy("id", "digest").agg(F.collect_list(column).alias(column))
    if found.where(F.octet_length("hot") > 0).limit(1).count():
        hot_ones = docs.select("id", "digest", "text").join(named(found, "hot").hint("shuffle_hash"), ["id", "digest"])
        found = found.unionByName(keep(find_stretches(hot_ones, shards, length, held, 1 << 62, again_cut=True), "stretches"))
    size = found.agg(F.sum("bytes")).first()[0]
    spans = found.where(F.size("starts") > 0).select("id", "digest", "starts", "ends")
    if not size:
        return spans
    return spans.unionByName(sort_stretches(docs, named(found, "ask"), max(FEW_SHARDS, -(-size // sorted_bytes)), length, memory, fetched))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans; spans that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    first = np.concatenate([[True], starts[1:] > ends[:-1]]) if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1] if len(at) else ends


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, **limits) -> DataFrame:
    """For every row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends; with carry also those columns and kept_text.

    kept_text drops the characters all of whose bytes are removed.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64(docs[text_col]).alias("digest"), docs[text_col].cast("string").alias("text"), docs[id_col].cast("bigint").alias("doc_id"), F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in carry] if carry else [F.lit(1).alias("none")]).alias("rest"))
    spans = repeated_spans(rows, length, **limits).groupBy("id", "digest").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = raw_bytes(batch.column(1))
            columns: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends", "kept_text")}
            for i in range(batch.num_rows):
                own = data[at[i] : at[i + 1]]
                lists = [batch.column(c)[i] for c in (2, 3)]
                starts, ends = merged(*[x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in lists])
                removed = np.zeros(len(own) + 1, np.int8)
                removed[starts] += 1
                removed[ends] -= 1
                gone = np.cumsum(removed[:-1]).astype(bool) if len(own) else np.zeros(0, bool)
                columns["n_bytes"].append(len(own))
                columns["n_removed"].append(int(gone.sum()))
                columns["n_spans"].append(len(starts))
                columns["kept_sha256"].append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
                columns["starts"].append(starts)
                columns["ends"].append(ends)
                if carry:
                    if gone.any():
                        heads = np.flatnonzero((own & 0xC0) != 0x80)
                        whole = np.repeat(np.logical_and.reduceat(gone, heads), np.diff(np.append(heads, len(own))))
                        columns["kept_text"].append(own[~whole].tobytes().decode())
                    else:
                        columns["kept_text"].append(batch.column(1)[i].as_py())
            if not carry:
                del columns["kept_text"]
            kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "kept_text": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), *[pa.array(v, kinds[k]) for k, v in columns.items()]], ["doc_id", "rest", *columns])

    joined = rows.join(spans.hint("shuffle_hash"), ["id", "digest"], "left").select("doc_id", "text", "starts", "ends", "rest")
    schema = StructType.fromDDL("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, ends array<bigint>" + (", kept_text string" if carry else ""))
    schema = StructType([schema[0], joined.schema["rest"], *schema[1:]])
    out = joined.mapInArrow(cut, schema)
    return out if carry else out.drop("rest")

"""Language-model scoring by context-tree weighting over bytes.

The text is lower-cased (A-Z), its words are joined by single spaces, and an
end byte follows, so that the model predicts the same tokens as the word base.
Each byte is predicted as eight binary decisions. A decision has a node in the
context of the last 0 to DEPTH bytes; a node holds its zeros and ones over the
training texts, their Krichevsky-Trofimov probability, and the weighted
mixture of that with its longer contexts. Prediction mixes all depths along
the path by the nodes' posterior weights.

The model is never gathered or broadcast; texts meet it in three shuffles:

1. Texts are written once as blocks of about BLOCK_BYTES. Tasks count the
   distinct (DEPTH+1)-byte strings and words of a block's training texts and
   send them to shards. Strings are dealt by their last two context bytes,
   each pair of bytes spread over SPREAD shards by the byte before, so that no
   frequent pair is one task's. A shard computes its nodes of depths DEPTH to 3.
2. Nodes of depth 2 are summed over the SPREAD shards of their byte pairs and
   sent back to these. Depths 0 and 1 (at most 65,535 nodes, 1 MB) are summed
   on the driver and broadcast.
3. Each block asks every shard for its distinct strings and words and gets one
   number for each; the block sums them up by text.

Words are told apart by 96 bits of a non-linear hash of their bytes and
length; where the first 64 are equal the other 32 are compared.

Defined cases: null, empty and blank texts are the end token alone; without
training rows N and V are 0 and every decision has probability one half; rows
that repeat are scored and counted each; a text longer than BLOCK_BYTES is a
block of its own; equal texts have equal scores; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import LOWER, ODD, SPACE, bounded_batches, crc_mod, distinct_sorted, mix, raw_bytes, release, slices, span_words, text_frame
from tessera.session import keep

DEPTH = 5
END = 10
#: Text bytes of a block. Its texts are handled in parts of a few MB.
BLOCK_BYTES = 16 << 20
#: Distinct strings or words that a counting task holds before it sends them on.
HELD = 1_500_000
#: Rows of the input a shard, bounds of the number of shards, and shards that share a byte pair.
SHARD_ROWS, FEW_SHARDS, MANY_SHARDS, SPREAD = 8_000, 16, 8192, 16
#: Strings that a shard looks up together.
TOGETHER = 400_000
_U = np.uint64
#: Kinds of rows, in the order in which a shard reads them.
NODES, PAIRS, WORDS, ASK_STRINGS, ASK_WORDS, ABOVE, TEXTS, TOP = range(8)
ROWS = "shard int, kind int, block bigint, blob binary, keys bigint, total bigint"


def sequences(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised texts, each after DEPTH end bytes of padding and before one end byte; starts of the texts proper; their ends (the end byte's place)."""
    raw, pad = LOWER[data].tobytes(), bytes([END]) * DEPTH
    texts = [b" ".join(raw[a:b].split()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = np.frombuffer(pad + (bytes([END]) + pad).join(texts) + bytes([END]), np.uint8)
    start = np.cumsum(size + DEPTH + 1) - size - 1
    return joined, start, start + size


def strings(joined: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (DEPTH+1)-byte string that ends at each byte of a text or its end byte, and each text's first among them."""
    n = len(joined) - DEPTH
    code = np.zeros(n, _U)
    for k in range(DEPTH + 1):
        code <<= _U(8)
        code |= joined[k : k + n]
    real = np.ones(n, bool)  # string i ends at byte i + DEPTH
    real[(start[1:, None] - 2 * DEPTH + np.arange(DEPTH)).ravel()] = False
    return code[real], np.concatenate([[0], np.cumsum(end - start + 1)])[:-1]


def words(joined: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes and the text number of every word."""
    solid = np.concatenate([[False], ~SPACE[joined], [False]])
    first, last = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~solid[1:])
    return *span_words(joined, first, last), np.searchsorted(start, first, "right") - 1


def word_order(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words, and whether each in that order differs from the one before."""
    order = np.argsort(one, kind="stable")
    for _ in range(2):
        a, b = one[order], two[order]
        same = a[1:] == a[:-1]
        if not (same & (b[1:] != b[:-1])).any():
            break
        order = np.lexsort((two, one))  # two words with one first hash
    return order, np.concatenate([np.ones(min(1, len(a)), bool), ~same | (b[1:] != b[:-1])])


def distinct_words(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, sorted, and the number among them of every word."""
    order, new = word_order(one, two)
    which = np.empty(len(one), np.int64)
    which[order] = np.cumsum(new) - 1
    return one[order][new], two[order][new], which


def find_words(known: tuple[np.ndarray, np.ndarray, np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Counts of words, 0 for unknown ones; known: (hashes, second hashes, counts), sorted."""
    n = np.zeros(len(one), np.int64)
    at = np.searchsorted(known[0], one)
    left = np.arange(len(one))
    while True:
        left = left[at[left] < len(known[0])]
        left = left[known[0][at[left]] == one[left]]
        if not len(left):
            return n
        found = known[1][at[left]] == two[left]
        n[left[found]] = known[2][at[left[found]]]
        left = left[~found]
        at[left] += 1


class WordSums:
    """Distinct words with added counts."""

    def __init__(self):
        self.held = (np.zeros(0, _U), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.more, self.waiting = [], 0

    def add(self, one: np.ndarray, two: np.ndarray, n: np.ndarray) -> None:
        self.more.append((one, two, n))
        self.waiting += len(one)
        if self.waiting > max(HELD // 2, len(self.held[0])):
            self.settle()

    def settle(self) -> None:
        if self.more:
            one, two, n = (np.concatenate(x) for x in zip(self.held, *self.more, strict=True))
            order, new = word_order(one, two)
            self.held = (one[order][new], two[order][new], np.add.reduceat(n[order], np.flatnonzero(new)) if len(n) else n)
            self.more, self.waiting = [], 0


class Sums:
    """Distinct keys with added counts, in sorted arrays."""

    def __init__(self):
        self.key, self.n, self.more, self.waiting = np.zeros(0, _U), np.zeros(0, np.int64), [], 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.more.append((key, n))
        self.waiting += len(key)
        if self.waiting > max(HELD // 2, len(self.key)):
            self.settle()

    def settle(self) -> None:
        if self.more:
            key = np.concatenate([self.key, *[k for k, _ in self.more]])
            n = np.concatenate([self.n, *[c for _, c in self.more]])
            self.key, self.n = added(key, n)
            self.more, self.waiting = [], 0


def added(key: np.ndarray, *values: np.ndarray):
    """Sorted distinct keys and the sums of each value."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key[first], *[np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values]


def narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series eight steps up."""
    x = np.asarray(x, np.float64)
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def decisions(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary nodes (context << 8 | bits so far, from 1) of strings (context << 8 | byte): key, zeros, ones."""
    keys, zeros, ones = [], [], []
    byte, context = key & _U(255), key & ~_U(255)
    for level in range(8):
        node = context | _U(1 << level) | (byte >> _U(8 - level))
        bit = ((byte >> _U(7 - level)) & _U(1)).astype(bool)
        k, z, o = added(node, np.where(bit, 0, n), np.where(bit, n, 0))
        keys.append(k)
        zeros.append(z)
        ones.append(o)
    key = np.concatenate(keys)
    order = np.argsort(key)
    return key[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]


def signed(chance: np.ndarray) -> np.ndarray:
    """Chances of a one as 32 bits: the lesser of both chances, below zero if it is that of a zero. So no chance becomes 0 or 1, however many counts it has."""
    return np.where(chance > 0.5, chance - 1, chance).astype(np.float32)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weighted probability, chance of a one, and weight of the node's own estimate."""
    own = log_kt(zeros, ones)
    chance = (ones + 0.5) / (zeros + ones + 1.0)
    if below is None:
        return own, chance, np.ones(len(own))
    mixed = np.logaddexp(own, below) - np.log(2)
    return mixed, chance, np.exp(own - np.log(2) - mixed)


def subtree(key: np.ndarray, n: np.ndarray, down_to: int) -> tuple[dict[int, tuple], tuple]:
    """Nodes of depths DEPTH to down_to of all strings with some last contexts; and the sums for the depth above."""
    tables, below = {}, None
    for depth in range(DEPTH, down_to - 1, -1):
        k, c = added(key & _U((1 << 8 * (depth + 1)) - 1), n)
        node, zeros, ones = decisions(k, c)
        mixed, chance, own = weigh(zeros, ones, below[1] if below else None)
        # the deepest nodes have all the weight themselves, and their counts are sums over ranges of strings
        tables[depth] = (k, c) if depth == DEPTH else (node, signed(chance), own.astype(np.float32))
        below = added(node & _U((1 << 8 * depth) - 1), mixed)
    k, c = added(key & _U((1 << 8 * down_to) - 1), n)
    node, zeros, ones = decisions(k, c)
    return tables, (node, zeros, ones, below[1])


def log10_of(key: np.ndarray, tables: dict[int, tuple]) -> np.ndarray:
    """Log probability of the last byte of each string after the bytes before it."""
    byte, total = key & _U(255), np.zeros(len(key))
    for level in range(8):
        prefix = _U(1 << level) | (byte >> _U(8 - level))
        one = ((byte >> _U(7 - level)) & _U(1)).astype(bool)
        p = np.full(len(key), 0.5)
        if DEPTH in tables:
            have, before = tables[DEPTH]
            low = (key & ~_U(255)) | ((byte >> _U(8 - level)) << _U(8 - level))
            a, b, c = (before[np.searchsorted(have, low + _U(x))] for x in (0, 1 << (7 - level), 1 << (8 - level)))
            p = (np.where(one, c - b, b - a) + 0.5) / (c - a + 1.0)
        for depth in range(DEPTH - 1, -1, -1):
            if depth not in tables:
                continue  # no node of this depth: one half, as p is yet
            have, chance, own = tables[depth]
            node = (((key >> _U(8)) & _U((1 << 8 * depth) - 1)) << _U(8)) | prefix
            at = np.searchsorted(have, node)
            at[at == len(have)] = 0
            weight = own[at].astype(np.float64)
            said = chance[at].astype(np.float64)
            said = np.where(one == (said < 0), 1 - np.abs(said), np.abs(said))
            p = np.where(have[at] == node, weight * said + (1 - weight) * p, 0.5)
        total += np.log10(p)
    return total



def shard_of_strings(key: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each string: its last two context bytes name SPREAD shards, the byte before one of these."""
    pair = (mix((key >> _U(8)) & _U(0xFFFF)) % _U(shards // SPREAD)).astype(np.int64)
    return pair * SPREAD + (mix(((key >> _U(24)) & _U(0xFF)) + _U(1)) % _U(SPREAD)).astype(np.int64)


def shard_of_words(one: np.ndarray, shards: int) -> np.ndarray:
    return (mix(one ^ ODD[1]) % _U(shards)).astype(np.int64)


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by shard, and the cuts between shards in that order."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (shard, kind, block, value[, keys, total]); the value is pickled."""
    full = [(*r[:3], pickle.dumps(r[3], protocol=5), *(r[4:] or (0, 0))) for r in rows]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*full, strict=True), kinds, strict=True)], ["shard", "kind", "block", "blob", "keys", "total"])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(shard, kind, block, value) of every row."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), pickle.loads(batch.column(3)[i].as_buffer())


def _texts(part: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A part's joined texts, their starts and their lengths."""
    return np.frombuffer(pa.decompress(part[4], part[3], "zstd", asbytes=True), np.uint8), part[5], part[6]


def _packed_strings(key: np.ndarray) -> tuple[int, bytes]:
    """Sorted strings, compressed byte by byte place."""
    return len(key), pa.compress(np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, : DEPTH + 1].T).tobytes(), "zstd", asbytes=True)


def _unpacked_strings(packed: tuple[int, bytes]) -> np.ndarray:
    n, data = packed
    out = np.zeros((n, 8), np.uint8)
    out[:, : DEPTH + 1] = np.frombuffer(pa.decompress(data, n * (DEPTH + 1), "zstd", asbytes=True), np.uint8).reshape(DEPTH + 1, n).T
    return out.view(_U)[:, 0]


def text_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """TEXTS rows from (doc_id, text, held): keys texts, of which total are for training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, parts, size = TaskContext.get().partitionId(), 0, [], 0
        done = lambda: _batch([(0, TEXTS, (task << 32) + number, parts, sum(len(p[2]) for p in parts), sum(int((~p[2]).sum()) for p in parts))])
        for batch in batches:
            data, at = raw_bytes(batch.column(1))
            for lo, hi in slices(at):
                joined, start, end = sequences(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                some = batch.slice(lo, hi - lo)
                if parts and size + len(joined) > block_bytes:
                    yield done()
                    number, parts, size = number + 1, [], 0
                packed = pa.compress(joined.tobytes(), "zstd", asbytes=True)
                parts.append((some.column(0).fill_null(0).to_numpy(), np.array(some.column(0).is_null()), np.array(some.column(2)), len(joined), packed, start, end - start))
                size += len(joined)
        if parts:
            yield done()
        release()

    return docs.select("doc_id", "text", "held").mapInArrow(run, ROWS)


def counted(blocks: DataFrame, shards: int) -> DataFrame:
    """NODES, WORDS and ABOVE rows of the training texts."""

    def send(strings_held: Sums, words_held: WordSums) -> Iterator[pa.RecordBatch]:
        strings_held.settle()
        words_held.settle()
        order, cut = _by_shard(shard_of_strings(strings_held.key, shards), shards)
        rows = [(s, NODES, 0, (_packed_strings(strings_held.key[order[a:b]]), narrow(strings_held.n[order[a:b]]))) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        one, two, n = words_held.held
        order, cut = _by_shard(shard_of_words(one, shards), shards)
        rows += [(s, WORDS, 0, (one[order[a:b]], two[order[a:b]], narrow(n[order[a:b]]))) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        if rows:
            yield _batch(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Sums(), WordSums())
        for *_, parts in _rows_of(batches):
            for part in parts:
                out = part[2]
                if out.all():
                    continue
                joined, start, size = _texts(part)
                code, _ = strings(joined, start, start + size)
                held[0].add(*np.unique(code[np.repeat(~out, size + 1)] if out.any() else code, return_counts=True))
                one, two, owner = words(joined, start)
                mine = ~out[owner]
                first, second, which = distinct_words(one[mine], two[mine])
                held[1].add(first, second, np.bincount(which, minlength=len(first)))
                if max(len(held[0].key), len(held[1].held[0])) > HELD:
                    yield from send(*held)
                    held = (Sums(), WordSums())
            release()
        yield from send(*held)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None

        def settled() -> Iterator[pa.RecordBatch]:
            held.settle()
            if now[1] == WORDS:
                one, two, n = held.held
                yield _batch([(now[0], WORDS, 0, (one, two, narrow(n)), len(n), int(n.sum()))])
            else:
                tables, above = subtree(held.key, held.n, 3)
                yield _batch([(now[0], NODES, 0, tables)])
                yield _batch([(now[0] // SPREAD, ABOVE, 0, above)])

        for shard, kind, _, value in _rows_of(batches):
            if (shard, kind) != now:
                if now is not None:
                    yield from settled()
                now, held = (shard, kind), WordSums() if kind == WORDS else Sums()
            held.add(*(value if kind == WORDS else (_unpacked_strings(value[0]), value[1])))
        if now is not None:
            yield from settled()
        release()

    sent = blocks.mapInArrow(count, ROWS)
    return sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind").mapInArrow(reduce, ROWS)


def pair_nodes(model: DataFrame, shards: int) -> DataFrame:
    """PAIRS rows, the nodes of depth 2 for each shard that needs them, and TOP rows, their sums for depth 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for pair, _, _, above in _rows_of(batches):
            got.setdefault(pair, []).append(above)
        for pair, parts in got.items():
            node, zeros, ones, below = added(*map(np.concatenate, zip(*parts, strict=True)))
            mixed, chance, own = weigh(zeros, ones, below)
            table = (node, signed(chance), own.astype(np.float32))
            yield _batch([*[(pair * SPREAD + s, PAIRS, 0, table) for s in range(SPREAD)], (0, TOP, 0, added(node & _U(0xFFFF), zeros, ones, mixed))])

    above = model.where(F.col("kind") == ABOVE)
    return above.repartitionById(shards // SPREAD, F.col("shard")).mapInArrow(run, ROWS)


def top_nodes(pairs: DataFrame) -> dict[int, tuple]:
    """Nodes of depths 1 and 0: at most 65,280 and 255."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, (node, zeros, ones, below) in _rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(zeros), pa.array(ones), pa.array(below)], ["node", "zeros", "ones", "below"])

    sums = pairs.where(F.col("kind") == TOP).mapInArrow(flat, "node bigint, zeros bigint, ones bigint, below double").groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))
    top = sums.toArrow().sort_by("node")
    node = top.column("node").to_numpy().astype(_U)
    if not len(node):
        return {}
    zeros, ones = top.column("zeros").to_numpy(), top.column("ones").to_numpy()
    mixed, chance, own = weigh(zeros, ones, top.column("below").to_numpy())
    root, z, o, below = added(node & _U(255), zeros, ones, mixed)
    _, root_chance, root_own = weigh(z, o, below)
    return {1: (node, signed(chance), own.astype(np.float32)), 0: (root, signed(root_chance), root_own.astype(np.float32))}


class Shard:
    """The nodes and words of one shard."""

    def __init__(self, number: int, top: dict[int, tuple]):
        self.number, self.tables = number, dict(top)
        self.words = (np.zeros(0, _U), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.key, self.logs = np.zeros(0, _U), None

    def hold(self, kind: int, value) -> None:
        if kind == WORDS:
            self.words = value
        elif kind == PAIRS:
            self.tables[2] = value
        else:
            self.key, count = value[DEPTH]
            self.tables |= value | {DEPTH: (self.key, np.concatenate([[0], np.cumsum(count, dtype=np.int64)]))}

    def log10(self, key: np.ndarray) -> np.ndarray:
        """Log probabilities of distinct strings; those of training's strings are computed once."""
        if self.logs is None:
            chunks = range(0, len(self.key), TOGETHER)
            self.logs = np.concatenate([np.zeros(0), *[log10_of(self.key[lo : lo + TOGETHER], self.tables) for lo in chunks]])
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        out = np.zeros(len(key))
        known = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        out[known] = self.logs[at[known]]
        out[~known] = log10_of(key[~known], self.tables)
        return out


def _distinct(parts: list[tuple]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """A block's distinct strings and words, sorted."""
    codes, hashes = [], []
    for part in parts:
        joined, start, size = _texts(part)
        codes.append(distinct_sorted(strings(joined, start, start + size)[0]))
        hashes.append(distinct_words(*words(joined, start)[:2])[:2])
    return distinct_sorted(np.concatenate(codes)), distinct_words(*map(np.concatenate, zip(*hashes, strict=True)))[:2]


def asked(blocks: DataFrame, shards: int) -> DataFrame:
    """ASK_STRINGS and ASK_WORDS rows: a block's distinct strings and words of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, block, parts in _rows_of(batches):
            code, (one, two) = _distinct(parts)
            order, cut = _by_shard(shard_of_strings(code, shards), shards)
            yield _batch([(s, ASK_STRINGS, block, _packed_strings(code[order[a:b]])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])
            order, cut = _by_shard(shard_of_words(one, shards), shards)
            rows = [(s, ASK_WORDS, block, (one[order[a:b]], two[order[a:b]])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
            if rows:
                yield _batch(rows)
            release()

    return blocks.mapInArrow(run, ROWS)


def answered(requests: DataFrame, model: DataFrame, shards: int, top) -> DataFrame:
    """The requests with their strings' log probabilities or their words' counts instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Shard | None = None
        waiting: list[tuple] = []

        def looked_up() -> Iterator[pa.RecordBatch]:
            if waiting:
                key = distinct_sorted(np.concatenate([k for _, k in waiting]))
                logs = held.log10(key)
                for block, k in waiting:
                    yield _batch([(held.number, ASK_STRINGS, block, logs[np.searchsorted(key, k)])])
                waiting.clear()

        for shard, kind, block, value in _rows_of(batches):
            if held is None or held.number != shard:
                yield from looked_up()
                held = Shard(shard, top.value)
                release()
            if kind in (NODES, PAIRS, WORDS):
                held.hold(kind, value)
            elif kind == ASK_WORDS:
                yield _batch([(shard, ASK_WORDS, block, narrow(find_words(held.words, *value)))])
            else:
                waiting.append((block, _unpacked_strings(value)))
                if sum(len(k) for _, k in waiting) > TOGETHER:
                    yield from looked_up()
        yield from looked_up()
        release()

    known = model.where(F.col("kind").isin(NODES, PAIRS, WORDS))
    met = requests.unionByName(known).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    return met.mapInArrow(run, ROWS)


def _gathered(code: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Place of each string among the sorted distinct ones; through a hash table, checked."""
    slots = 22
    place = lambda k: ((k * ODD[0]) >> _U(64 - slots)).astype(np.int64)
    table = np.zeros(1 << slots, np.int32)
    table[place(distinct)] = np.arange(len(distinct), dtype=np.int32)
    at = table[place(code)]
    wrong = np.flatnonzero(distinct[at] != code)
    at[wrong] = np.searchsorted(distinct, code[wrong])
    return at


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double, bytes bigint"


def _finished(shards: int, trained: int):
    def run(group: pa.Table) -> pa.Table:
        answers: dict[int, dict[int, np.ndarray]] = {ASK_STRINGS: {}, ASK_WORDS: {}}
        for shard, kind, _, value in _rows_of(group.to_batches()):
            if kind == TEXTS:
                parts = value
            else:
                answers[kind][shard] = value
        distinct, (one, two) = _distinct(parts)
        order, cut = _by_shard(shard_of_strings(distinct, shards), shards)
        logs = np.zeros(len(distinct))
        for s, values in answers[ASK_STRINGS].items():
            logs[order[cut[s] : cut[s + 1]]] = values
        order, cut = _by_shard(shard_of_words(one, shards), shards)
        n = np.zeros(len(one), np.int64)
        for s, values in answers[ASK_WORDS].items():
            n[order[cut[s] : cut[s + 1]]] = values
        found = []
        for part in parts:
            ids, null, held = part[:3]
            joined, start, size = _texts(part)
            code, first = strings(joined, start, start + size)
            score = np.add.reduceat(logs[_gathered(code, distinct)], first)
            first_hash, second, owner = words(joined, start)
            times = find_words((one, two, n), first_hash, second)
            tokens = np.bincount(owner, minlength=len(start)) + 1
            known = np.bincount(owner[times > 0], minlength=len(start)) + (trained > 0)
            base = np.bincount(owner, np.log10(times + 1.0), len(start)) + np.log10(trained + 1.0)
            columns = [pa.array(ids, mask=null), pa.array(held), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score), pa.array(size + 1)]
            found.append(pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "bytes"]))
        release()
        return pa.concat_tables(found)

    return run


def score_documents(docs: DataFrame, folds: int = 7, held_out: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of (doc_id, text).

    bits_per_byte: the code length of the normalised text and its end byte, over their number of bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = text_frame(docs).withColumn("held", crc_mod("doc_id", folds) == held_out)
    blocks = keep(text_blocks(rows, block_bytes), "lm-blocks")
    texts, trained, n_blocks = blocks.agg(F.sum("keys"), F.sum("total"), F.count("*")).first()
    texts, trained = texts or 0, trained or 0
    shards = min(MANY_SHARDS, max(FEW_SHARDS, -(-texts // SHARD_ROWS)))
    shards = -(-shards // SPREAD) * SPREAD
    model = keep(counted(blocks, shards), "lm-model")
    got = model.where(F.col("kind") == WORDS).agg(F.sum("keys"), F.sum("total")).first()
    vocabulary, tokens = (got[0] or 0) + (trained > 0), (got[1] or 0) + trained
    pairs = keep(pair_nodes(model, shards), "lm-pairs")
    top = spark.sparkContext.broadcast(top_nodes(pairs))
    answers = answered(asked(blocks, shards), model.unionByName(pairs), shards, top)
    met = answers.unionByName(blocks).repartition(max(1, n_blocks), "block")
    scored = met.groupBy("block").applyInArrow(_finished(shards, trained), SCORED)
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(tokens + vocabulary + 1)))
    bits = -F.col("score") / F.lit(float(np.log10(2))) / F.col("bytes")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))

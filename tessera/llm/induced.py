"""External induced suffix sorting with common-prefix values.

Suffix tuples (position, common prefix with the tuple before it) go through
two monotone priority queues, keyed by first symbol and first-in-first-out
within one, which is the order of induction. What a queue holds beyond its
memory goes to run files, each with an index of its symbols. Texts, seeds,
their common prefixes, names and sorted parts of every level are files that
are mapped, not held; tuples are handled in vectorised chunks. In memory are
the queues' share, the seeds of one range of first symbols while these are
named, and a reduced string of at most `base` names.

Larger-type suffixes are induced upwards from the sorted leftmost-smaller
ones, smaller-type suffixes downwards from those. Leftmost-smaller suffixes
are sorted by naming their substrings, and recursively where names repeat;
a reduced string of at most `base` names is sorted by prefix doubling.

An induced tuple's common prefix is one more than the least value passed in
the scan since its queue's last tuple; values are held to `cap`.
"""

from __future__ import annotations

import heapq
import os
import shutil
import tempfile
from collections.abc import Iterator
from itertools import chain, count

import numpy as np

CHUNK = 1 << 19
#: Seeds that are named together, if no single first symbol has more.
NAMED = 1 << 20
#: Whole binary logarithms.
_LOG = np.frexp(np.arange(CHUNK + 1))[1].astype(np.int8) - 1
#: Numbers of files, so that no level of the recursion writes over another's.
_FILES = count()


class SuffixQueue:
    """Monotone priority queue of suffix tuples, on disk beyond `memory` tuples."""

    def __init__(self, folder: str, memory: int, ascending: bool = True):
        self.folder, self.memory, self.sign = folder, memory, 1 if ascending else -1
        self.held: dict[int, list] = {}
        self.count, self.runs, self.symbols, self.queued = 0, [], [], set()

    def push(self, symbol: int, pos: np.ndarray, common: np.ndarray) -> None:
        self.held.setdefault(symbol, []).append((pos, common))
        self.count += len(pos)
        if symbol not in self.queued:
            self.queued.add(symbol)
            heapq.heappush(self.symbols, self.sign * symbol)
        if self.count > self.memory:
            self.spill()

    def spill(self) -> None:
        path = os.path.join(self.folder, f"run{next(_FILES)}")
        index = {}
        with open(path, "wb") as f:
            for symbol, parts in self.held.items():
                pos, common = (np.concatenate(x) for x in zip(*parts, strict=True))
                index[symbol] = (f.tell(), len(pos))
                f.write(pos.astype(np.int64).tobytes())
                f.write(common.tobytes())
        self.runs.append((path, index))
        self.held, self.count = {}, 0

    def top(self) -> int | None:
        return self.sign * self.symbols[0] if self.symbols else None

    def drop(self) -> None:
        self.queued.discard(self.sign * heapq.heappop(self.symbols))

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of the symbol's tuples, including those pushed while these are read."""
        for path, index in self.runs:
            if symbol in index:
                yield from _read(path, *index.pop(symbol))
        while symbol in self.held or any(symbol in index for _, index in self.runs):
            for path, index in self.runs:
                if symbol in index:
                    yield from _read(path, *index.pop(symbol))
            parts = self.held.pop(symbol, [])
            while parts:
                # parts come from chunks, so none is longer than one
                n = max(1, int(np.searchsorted(np.cumsum([len(p) for p, _ in parts]), CHUNK, "right")))
                pos, common = (np.concatenate(x) for x in zip(*parts[:n], strict=True))
                parts = parts[n:]
                self.count -= len(pos)
                yield pos, common


    def backwards(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of the symbol's tuples, the last ones first; nothing is pushed meanwhile."""
        for pos, common in reversed(self.held.pop(symbol, [])):
            self.count -= len(pos)
            yield pos, common
        for path, index in reversed(self.runs):
            if symbol in index:
                yield from _read(path, *index.pop(symbol), backwards=True)


def _read(path: str, at: int, n: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    pos = np.memmap(path, np.int64, "r", at, (n,))
    common = np.memmap(path, np.uint8, "r", at + 8 * n, (n,))
    starts = range(0, n, CHUNK)
    for lo in reversed(starts) if backwards else starts:
        yield np.array(pos[lo : lo + CHUNK]), np.array(common[lo : lo + CHUNK])


class _Minima:
    """Least value passed since each symbol's last push; range minima inside a chunk by doubling."""

    def __init__(self, symbols: int, cap: int):
        self.since, self.cap = np.zeros(symbols, np.uint8), cap

    def pushed(self, values: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Common prefixes of the tuples pushed by entries `at` (grouped by symbol, ascending within one)."""
        n = len(values)
        levels = np.empty((n.bit_length(), n), np.uint8)  # row k: minima of 1 << k values, as far as these go
        levels[0] = values
        for k in range(1, len(levels)):
            half, size = 1 << (k - 1), n - (1 << k) + 1
            np.minimum(levels[k - 1, :size], levels[k - 1, half : half + size], out=levels[k, :size])
        first = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        begin = np.where(first, 0, np.concatenate([[0], at[:-1] + 1]))
        least = self._ranges(levels, begin, at + 1)
        least[first] = np.minimum(least[first], self.since[symbol[first]])
        self.since = np.minimum(self.since, values.min())
        last = np.concatenate([first[1:], [True]])
        tail = at[last] + 1
        inside = tail < len(values)
        rest = np.full(len(tail), self.cap, np.uint8)
        rest[inside] = self._ranges(levels, tail[inside], np.full(int(inside.sum()), len(values)))
        self.since[symbol[last]] = rest
        return np.minimum(least.astype(np.int16) + 1, self.cap).astype(np.uint8)

    def passed(self, values: np.ndarray) -> None:
        self.since = np.minimum(self.since, values.min())

    @staticmethod
    def _ranges(levels: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = _LOG[np.maximum(end - begin, 1)].astype(np.int64)
        row = level * levels.shape[1]
        flat = levels.ravel()
        return np.minimum(flat[row + begin], flat[row + end - (1 << level)])


def _common(text: np.ndarray, p: int, q: int, cap: int) -> int:
    a, b = text[p : p + cap], text[q : q + cap]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _lanes(text: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place but the last seven, as one number, first byte lowest."""
    return np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text).data, strides=(1,))


def _eight(lanes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, also near the text's end; bytes after it are zeros."""
    inside = np.minimum(p, len(lanes) - 1)
    beyond = p - inside
    return np.where(beyond < 8, lanes[inside] >> (8 * np.minimum(beyond, 7)).astype(np.uint64), np.uint64(0))


def _neighbours(text: np.ndarray, pos: np.ndarray, cap: int) -> Iterator[np.ndarray]:
    """Common prefix of each suffix of a sorted list with the one before it, in chunks; bytes after the text count as zeros, as its end."""
    lanes = _lanes(text if len(text) >= 8 else np.concatenate([text, np.zeros(8, np.uint8)]))
    for lo in range(0, len(pos), CHUNK):
        a = np.array(pos[lo : lo + CHUNK])
        b = np.array(pos[max(0, lo - 1) : lo + len(a) - 1])
        out = np.zeros(len(a), np.uint8)
        at = np.arange(len(a) - len(b), len(a))
        a = a[len(a) - len(b) :]
        late = np.maximum(a, b) + cap >= len(lanes)
        for own, read in ((np.flatnonzero(~late), lambda p: lanes[p]), (np.flatnonzero(late), lambda p: _eight(lanes, p))):
            x, y, left = a[own], b[own], at[own]
            for k in range(0, cap, 8):
                if not len(left):
                    break
                differ = read(x) ^ read(y)
                same = np.flatnonzero(differ == 0)
                low = differ & (~differ + np.uint64(1))
                out[left] = np.minimum(k + (np.bitwise_count(low - np.uint64(1)) >> 3), cap)
                x, y, left = x[same] + 8, y[same] + 8, left[same]
        yield out


def leftmost_smaller(text: np.ndarray) -> Iterator[np.ndarray]:
    """Positions, from the last, whose suffix is smaller than the next one while the suffix before it is larger; the sentinel's too."""
    after, n = True, len(text)
    if n > 1 and not bool(text[n - 2] > text[n - 1]):
        raise ValueError("the text must end with a smallest symbol of its own")
    hi = n - 1
    yield np.array([n - 1])
    while hi > 0:
        lo = max(0, hi - CHUNK)
        now, nxt = np.array(text[lo:hi]), np.array(text[lo + 1 : hi + 1])
        place = np.where(now != nxt, np.arange(hi - lo), hi - lo)
        place = np.minimum.accumulate(place[::-1])[::-1]
        smaller = np.append(now < nxt, after)[place]
        edge = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1 + lo
        if after and hi < n - 1 and not smaller[-1]:
            yield np.array([hi])
        yield edge[::-1]
        after, hi = bool(smaller[0]), lo


def _symbol_ranges(text: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of first symbols with about NAMED seeds each."""
    count = np.zeros(0, np.int64)
    for lo in range(0, len(starts), CHUNK):
        more = np.bincount(text[starts[lo : lo + CHUNK]], minlength=len(count))
        more[: len(count)] += count
        count = more
    before = np.cumsum(count) // NAMED
    cut = [0, *(np.flatnonzero(before[1:] != before[:-1]) + 1).tolist(), len(count)]
    yield from zip(cut[:-1], cut[1:], strict=True)


#: Masks of the first k bytes of eight, the first one highest.
_FIRST = np.array([0, *[((1 << 8 * k) - 1) << 8 * (8 - k) for k in range(1, 9)]], np.uint64)


def _sevens(lanes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first seven bytes of each substring as one number, that orders them as their names.

    A substring that ends sorts after all that begin with it and go on, so the rest of it counts as largest bytes. No substring
    ends with the largest byte, since a start is smaller than the byte before it.
    """
    word = _eight(lanes, start) if len(start) and int(start.max()) >= len(lanes) else lanes[start]
    first = _FIRST[np.minimum(end - start + 1, 7)]
    word = word.byteswap() & first
    ended = end - start < 7
    word[ended] |= ~first[ended]
    return word


def _names(text: np.ndarray, starts: np.ndarray, marks: np.ndarray, names: np.ndarray) -> int:
    """Fills in order-preserving names of the substrings from each start to the next one, inclusive; how many there are."""
    wide = text.dtype.itemsize > 1
    step, bits = (1, 33) if wide else (6, 10)
    lanes = _lanes(text) if text.dtype == np.uint8 and len(text) >= 8 else None
    for lo in range(0, len(starts), CHUNK):
        marks[starts[lo : lo + CHUNK]] = True
    total = 0
    for least, most in _symbol_ranges(text, starts):
        group = []
        for lo in range(0, len(starts), CHUNK):
            first = text[starts[lo : lo + CHUNK]]
            group.append(lo + np.flatnonzero((first >= least) & (first < most)))
        group = np.concatenate(group)
        if not len(group):
            continue
        begin, end = starts[group], starts[np.minimum(group + 1, len(starts) - 1)]
        rank = np.zeros(len(group), np.int64)  # dense ranks by the symbols read so far
        open_ = np.arange(len(group))
        at = 0
        while len(open_):
            s, e = begin[open_], end[open_]
            now = step if at or lanes is None else 7
            if now == 7:
                word = _sevens(lanes, s, e)
            else:
                word = np.zeros(len(open_), np.uint64)
                for k in range(step):
                    p = np.minimum(s + at + k, e)
                    inside = s + at + k <= e
                    # a substring's end is a start; marked, it sorts after the same symbol unmarked
                    value = (text[p].astype(np.uint64) << np.uint64(1)) | (marks[p] & ((at + k) > 0)).astype(np.uint64)
                    word = (word << np.uint64(bits)) | np.where(inside, value + np.uint64(1), np.uint64(0))
            order = np.argsort(word) if at == 0 else np.lexsort((word, rank[open_]))
            r, w = rank[open_][order], word[order]
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])
            # ranks are places, so that splitting one rank leaves the others' order
            base = np.concatenate([[True], r[1:] != r[:-1]])
            within = np.arange(len(r)) - np.maximum.accumulate(np.where(base, np.arange(len(r)), 0))
            place = r + np.maximum.accumulate(np.where(new, np.arange(len(r)), 0)) - (np.arange(len(r)) - within)
            rank[open_[order]] = place
            at += now
            size = np.bincount(np.cumsum(new) - 1)
            alone = np.zeros(len(open_), bool)
            alone[order] = size[np.cumsum(new) - 1] == 1
            done = s + at > e
            open_ = open_[~alone & ~done]
        taken = np.zeros(len(rank), np.int64)
        taken[rank] = 1
        number = np.cumsum(taken)
        names[group] = number[rank] - 1 + total
        total += int(number[-1])
    return total


def _doubling(names: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix order of a string in memory; with a depth, by so many first symbols at least, then in any order."""
    n = len(names)
    depth = n if depth is None else min(n, depth)
    rank, k = names.astype(np.int64), 1
    bits = n.bit_length()
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        if 3 * bits <= 63:  # places fit beside the keys, and numbers sort faster than places
            key = np.sort((key << bits) | np.arange(n))
            order, key = key & ((1 << bits) - 1), key >> bits
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1 or k >= n or 2 * k >= depth:
                return order
            k = min(2 * k, n)
            continue
        order = np.argsort(key)
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or k >= n or 2 * k >= depth:
            return order
        k = min(2 * k, n)


class InducedSorter:
    """Sorts the suffixes of texts that end with a symbol 0 that is nowhere else.

    A shallow sorter looks at no more symbols than the cap of common prefixes: suffixes that share so many stand
    together in any order. Induction keeps such an order, and capped common prefixes are the same.
    """

    def __init__(self, memory: int = 4_000_000, base: int = 8_000_000, folder: str | None = None, shallow: bool = False):
        self.memory, self.base, self.shallow = memory, base, shallow
        self.recursions, self.queues = 0, []
        self.folder = tempfile.mkdtemp(prefix="suffixes-", dir=folder)

    def __enter__(self) -> InducedSorter:
        return self

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def mapped(self, chunks: Iterator[np.ndarray], kind: type, backwards: bool = False) -> np.ndarray:
        """Chunks one after the other in a file, or in the opposite order of all their values."""
        path = os.path.join(self.folder, f"kept{next(_FILES)}")
        with open(path, "wb") as f:
            n = sum(len(c) for c in chunks if f.write(np.ascontiguousarray(c, kind).data) or True)
        out = np.memmap(path, kind, "r", shape=(n,)) if n else np.zeros(0, kind)
        os.unlink(path)  # the mapping holds the file until it goes
        return out[::-1] if backwards else out

    def blank(self, n: int, kind: type) -> np.ndarray:
        """Zeros in a file."""
        path = os.path.join(self.folder, f"kept{next(_FILES)}")
        out = np.memmap(path, kind, "w+", shape=(n,))
        os.unlink(path)
        return out

    def order(self, text: np.ndarray, depth: int | None = None) -> np.ndarray:
        """All positions in suffix order, of which the first `depth` symbols count."""
        if len(text) <= self.base:
            return _doubling(np.array(text), depth)
        self.recursions += 1
        last = iter([np.array([len(text) - 1])])
        return self.mapped(chain((pos for pos, _ in self.descending(text, 0)), last), np.int64, backwards=True)

    def sorted_seeds(self, text: np.ndarray, cap: int = 0) -> np.ndarray:
        starts = self.mapped(leftmost_smaller(text), np.int64, backwards=True)
        if len(starts) == 1:
            return np.array(starts)
        names = self.blank(len(starts), np.int64)
        distinct = _names(text, starts, self.blank(len(text) + 1, bool), names)
        if distinct == len(names):
            out = self.blank(len(starts), np.int64)
            for lo in range(0, len(starts), CHUNK):
                out[names[lo : lo + CHUNK]] = starts[lo : lo + CHUNK]
            return out
        # seeds lie two symbols apart at least, so half as many names tell them apart
        order = self.order(names, (cap + 1) // 2 if self.shallow and cap else None)
        return self.mapped((starts[order[lo : lo + CHUNK]] for lo in range(0, len(order), CHUNK)), np.int64)

    def _queue(self, ascending: bool = True) -> SuffixQueue:
        self.queues.append(SuffixQueue(self.folder, self.memory, ascending))
        return self.queues[-1]

    @property
    def spills(self) -> int:
        """Run files that the queues have written."""
        return sum(len(q.runs) for q in self.queues)

    @staticmethod
    def _seed_cuts(text: np.ndarray, seeds: np.ndarray) -> tuple[list[int], list[int]]:
        """The first symbols of the sorted seeds, and where each begins."""
        symbols, cuts = [], []
        for lo in range(0, len(seeds), CHUNK):
            own = text[seeds[lo : lo + CHUNK]]
            at = np.flatnonzero(np.concatenate([[not symbols or own[0] != symbols[-1]], own[1:] != own[:-1]]))
            symbols += own[at].tolist()
            cuts += (at + lo).tolist()
        return symbols, [*cuts, len(seeds)]

    def descending(self, text: np.ndarray, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Chunks of (position, common prefix with the position before it), largest suffix first; without the sentinel.

        cap 0 leaves common prefixes out.
        """
        if len(text) < 2:
            return
        seeds = self.sorted_seeds(text, cap)
        commons = self.mapped(_neighbours(text, seeds, cap), np.uint8) if cap else self.blank(len(seeds), np.uint8)
        symbols = int(text.max()) + 1
        up, larger = self._queue(), self._queue()
        minima = _Minima(symbols, cap) if cap else None
        seed_symbol, seed_cut = self._seed_cuts(text, seeds)
        next_seed = 0
        while next_seed < len(seed_cut) - 1 or up.top() is not None:
            seed_now = seed_symbol[next_seed] if next_seed < len(seed_cut) - 1 else None
            symbol = min(x for x in (seed_now, up.top()) if x is not None)
            last = None
            if up.top() == symbol:
                fresh = True
                for pos, common in up.take(symbol):
                    if fresh:
                        common, fresh = common.copy(), False
                        common[0] = 0
                    last = int(pos[-1])
                    larger.push(symbol, pos, common)
                    self._induce(text, pos, common, symbol, up, minima, lambda b, c=symbol: b >= c)
                up.drop()
            if seed_now == symbol:
                a, b = seed_cut[next_seed], seed_cut[next_seed + 1]
                for lo in range(a, b, CHUNK):
                    pos, common = np.array(seeds[lo : min(b, lo + CHUNK)]), np.array(commons[lo : min(b, lo + CHUNK)])
                    if lo == a:
                        common[0] = _common(text, last, int(pos[0]), cap) if last is not None and cap else 0
                    self._induce(text, pos, common, symbol, up, minima, lambda b, c=symbol: b > c)
                next_seed += 1
        del seeds, commons
        down = self._queue(ascending=False)
        minima = _Minima(symbols, cap) if cap else None
        left = sorted(larger.queued)
        while left or down.top() is not None:
            symbol = max(x for x in (left[-1] if left else None, down.top()) if x is not None)
            last = None
            if down.top() == symbol:
                fresh = True
                for pos, common in down.take(symbol):
                    if fresh:
                        common, fresh = common.copy(), False
                        common[0] = 0
                    last = int(pos[-1])
                    self._induce(text, pos, common, symbol, down, minima, lambda b, c=symbol: b <= c)
                    yield pos, common
                down.drop()
            if left and left[-1] == symbol:
                left.pop()
                carry = None
                for pos, common in larger.backwards(symbol):
                    # the value of a tuple now belongs to the one after it in this direction
                    pos, own = pos[::-1], common[::-1]
                    if carry is None:
                        carry = _common(text, last, int(pos[0]), cap) if last is not None and cap else 0
                    common = np.concatenate([np.array([carry], np.uint8), own[:-1]])
                    carry = int(own[-1])
                    self._induce(text, pos, common, symbol, down, minima, lambda b, c=symbol: b < c)
                    yield pos, common

    @staticmethod
    def _induce(text, pos, common, symbol, queue, minima, follows) -> None:
        before = text[np.maximum(pos - 1, 0)]
        at = np.flatnonzero((pos > 0) & follows(before) & (before > 0))
        if not len(at):
            if minima is not None:
                minima.passed(common)
            return
        order = np.argsort(before[at], kind="stable")
        at = at[order]
        to = before[at].astype(np.int64)
        values = minima.pushed(common, at, to) if minima is not None else np.zeros(len(at), np.uint8)
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() + [len(to)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            queue.push(int(to[a]), pos[at[a:b]] - 1, values[a:b])

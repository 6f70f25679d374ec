"""Best-fit packing by a grouping genetic algorithm.

Documents become token pieces of at most CAPACITY; full pieces are sequences
at once. The others are dealt by hash into shards of about SHARD_PIECES. Each
shard has ISLANDS populations, each evolved by a task of its own, and after
each epoch an island's elite goes with the next shuffle to the next island of
the ring. A solution's genes are whole bins: crossover injects well-filled
bins of one parent into another, removes the bins that hold duplicates, and
best-fits the displaced documents; it also dissolves the loosest bins. Every
epoch runs, whatever the first solutions are worth: at an equal number of bins
the fitter solution has its free room in fewer of them, and so leaves more for
the level above.

Bins of the best solution that are nearly full are final. Of the others the
loosest, of at most SHARD_PIECES / MERGE pieces, move on to a shard made of
MERGE shards; the rest are final too. So the open bins of the whole corpus
meet, level by level, and no shard of any level expects more than SHARD_PIECES
pieces, whatever their lengths.

Token ids: texts of plain characters without `<|` are lower-cased and cut at
white space, and the ids of each part are remembered, since no token of this
tokenizer spans white space; all other texts, and all texts where the file has
another pre-tokenizer, go through the library whole.

Defined cases: null and empty text is the end id alone; repeated rows are
documents of their own, told apart by their order among equals; pieces of
equal length are taken in the order of their hashed names; longer documents
are cut into full pieces and a rest, however long; an empty table gives no
pieces; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import pickle
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import bounded_batches, memos, release, text_frame
from tessera.session import keep

CAPACITY, END_ID = 4096, 1
SHARD_PIECES, MERGE = 20_000, 32
#: Pieces of open bins that any shard may pass on, however small the shards are made.
LEAST_PASSED = 64
#: Islands of a shard, solutions of an island, epochs, and crossovers an epoch on each island.
ISLANDS, POPULATION, EPOCHS, CROSSOVERS = 2, 3, 2, 24
#: Of the fuller half of a parent's bins, one in this many is injected; one in this many of the other's bins is dissolved.
INJECTED, DISSOLVED = 24, 100
#: Most tasks of a shuffle; with more islands a task evolves several, one after the other.
TASKS = 10_000
#: Bins with at most this much room left are final below the last level.
NEARLY = 4
#: Parts between white space whose ids a tokenizing process remembers, in two halves: the older goes when the newer is full.
REMEMBERED = 1_000_000
# The words of the tokenizer's own pre-tokenizer, for texts of plain characters, on which no two libraries differ.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0132-\u0148\u014a-\u017e]*")


class Ids:
    """Token ids of texts, with the ids of plain words remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path, self.model = path, Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.splits = self._splits_words()
        if self.splits:
            # the same merges for words that are split and lower-cased already
            told = json.loads(self.model.to_str())
            told["normalizer"] = None
            told["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
            self.by_word = Tokenizer.from_str(json.dumps(told))
            suffix = told["model"].get("end_of_word_suffix") or ""
            self.ends = np.zeros(1 + max(self.model.get_vocab().values()), bool)
            self.ends[[i for w, i in self.model.get_vocab().items() if suffix and w.endswith(suffix)]] = True

    def _splits_words(self) -> bool:
        """Whether the file has the lower-casing word splitter that _SPLIT stands for."""
        told = json.loads(self.model.to_str())
        parts = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        same = (parts[0].get("pattern") or {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return same and any(n.get("type") == "Lowercase" for n in (told.get("normalizer") or {}).get("normalizers", []))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found: list = [None] * len(texts)
        plain, other = [], []
        for i, text in enumerate(texts):
            (plain if self.splits and "<|" not in text and _PLAIN.fullmatch(text) else other).append(i)
        if other:
            for i, e in zip(other, self.model.encode_batch_fast([texts[i] for i in other], add_special_tokens=False), strict=True):
                found[i] = np.array(e.ids, np.uint32)
        if plain:
            lists = pc.ascii_split_whitespace(pa.array([texts[i].lower() for i in plain], pa.large_string()))
            coded = lists.flatten().dictionary_encode()
            part, at = coded.indices.to_numpy(), lists.offsets.to_numpy()
            ids = self._ids_of(coded.dictionary.to_pylist())
            size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
            flat, first, n = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size, size[part]
            end = np.cumsum(n)
            flat = flat[np.repeat(first[part] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
            cut = np.concatenate([[0], end])[at]
            for i, lo, hi in zip(plain, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                found[i] = flat[lo:hi]
        return found

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts between white space, with new ones learned first."""
        if len(self.parts) > REMEMBERED // 2:
            self.older, self.parts = self.parts, {}
        known = self.parts
        known[""] = b""
        got = list(map(known.get, parts))
        missing = [w for w, ids in zip(parts, got, strict=True) if ids is None]
        if missing:
            # those that the older half still has move over; the others are learned
            older = list(map(self.older.get, missing))
            known.update((w, ids) for w, ids in zip(missing, older, strict=True) if ids is not None)
            self._learn([w for w, ids in zip(missing, older, strict=True) if ids is None])
            got = list(map(known.__getitem__, parts))
        return got

    def _learn(self, fresh: list[str]) -> None:
        """Ids of parts between white space, from those of their words; no word spans white space."""
        known = self.parts
        mixed = [p for p in fresh if not p.isalpha()]
        split = [_SPLIT.findall(p) for p in mixed]
        new = [p for p in fresh if p.isalpha()]
        new += {w for s in split for w in s}.difference(known, new)
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            lines = [" ".join(some[i : i + 100]) for i in range(0, len(some), 100)]
            ids = np.fromiter(chain.from_iterable(e.ids for e in self.by_word.encode_batch_fast(lines, add_special_tokens=False)), "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(some):  # one word end for each word
                flat, at = ids.tobytes(), (4 * cut).tolist()
                known.update(zip(some, map(flat.__getitem__, map(slice, [0, *at[:-1]], at)), strict=True))
            else:
                known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, self.model.encode_batch_fast(some, add_special_tokens=False), strict=True))
        known.update((p, b"".join(map(known.__getitem__, s))) for p, s in zip(mixed, split, strict=True))


_loaded: dict[str, Ids] = {}
memos.append(_loaded)


def _hand_back() -> None:
    """As release(), but for this module's own memo. A function of the module, since a task's closure would hold a copy of the memo."""
    release(_loaded)


def tokenizer(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, row_key, piece, start, length, ids_crc32[, ids] of every row of (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, made, salt = None, [], 0
        for batch in batches:
            model = model or tokenizer(path)
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), model.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                salt += 1
                for n, lo in enumerate(range(0, len(ids), capacity)):
                    own = ids[lo : lo + capacity].tobytes()
                    rows.append((doc, n, lo, len(own) // 4, zlib.crc32(own), salt, own))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: len(names)]
            yield pa.RecordBatch.from_arrays(made, names)
        _hand_back()

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def place(length: np.ndarray, order: np.ndarray, room: list[int], capacity: int) -> list[int]:
    """The bin of each item, in the order given: that where it leaves least room. New bins are added to room."""
    shelves: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, found = 0, []
    for b, r in enumerate(room):
        if r:
            shelves[r].append(b)
            mask |= 1 << r
    for n in length[order].tolist():
        fits = mask >> n
        if fits:
            r = n + ((fits & -fits).bit_length() - 1)
            b = shelves[r].pop()
            if not shelves[r]:
                mask &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(r)
        found.append(b)
        r -= n
        room[b] = r
        if r:
            shelves[r].append(b)
            mask |= 1 << r
    return found


def best_fit(length: np.ndarray, order: np.ndarray, bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Put the items, in the order given, each into the bin where it leaves least room."""
    for i, b in zip(order.tolist(), place(length, order, room, capacity), strict=True):
        if b == len(bins):
            bins.append([])
        bins[b].append(i)


class Packing:
    """One solution: the bin of each item, and the room in each bin."""

    def __init__(self, bin_of: np.ndarray, room: np.ndarray, capacity: int):
        self.bin_of, self.room = bin_of, room
        self.fitness = (len(room), -float((((capacity - room) / capacity) ** 2).sum()))

    @property
    def bins(self) -> list[list[int]]:
        order = np.argsort(self.bin_of, kind="stable")
        return [own.tolist() for own in np.split(order, np.cumsum(np.bincount(self.bin_of, minlength=len(self.room)))[:-1])]


def crossover(a: Packing, b: Packing, length: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Inject some of a's fuller bins into b, drop b's bins that hold the same items and its loosest, best-fit what is displaced."""
    full = np.argsort(a.room, kind="stable")[: max(1, len(a.room) // 2)]
    injected = np.zeros(len(a.room), bool)
    injected[rng.choice(full, max(1, len(full) // INJECTED), replace=False)] = True
    taken = injected[a.bin_of]
    gone = np.zeros(len(b.room), bool)
    gone[b.bin_of[taken]] = True
    gone[np.argsort(-b.room, kind="stable")[: max(1, len(b.room) // DISSOLVED)]] = True
    stays = int((~gone).sum())
    bin_of = np.where(taken, stays + np.cumsum(injected)[a.bin_of] - 1, np.cumsum(~gone)[b.bin_of] - 1)
    room = [*b.room[~gone].tolist(), *a.room[injected].tolist()]
    free = np.flatnonzero(gone[b.bin_of] & ~taken)
    free = free[np.argsort(-length[free], kind="stable")]
    bin_of[free] = place(length, free, room, capacity)
    return Packing(bin_of, np.array(room, np.int64), capacity)


def first_population(length: np.ndarray, capacity: int, island: int, rng: np.random.Generator) -> list[Packing]:
    """Best-fit decreasing (on the first island), and best fit in orders that depart from it more and more."""
    made = []
    for p in range(POPULATION):
        noise = 0.05 * (p + island)
        order = np.argsort(-length * (1 + noise * rng.random(len(length))), kind="stable")
        room: list[int] = []
        bin_of = np.zeros(len(length), np.int64)
        bin_of[order] = place(length, order, room, capacity)
        made.append(Packing(bin_of, np.array(room, np.int64), capacity))
    return made


def epoch(population: list[Packing], migrant: Packing | None, length: np.ndarray, capacity: int, rng: np.random.Generator) -> int:
    """Crossovers on one island, after a migrant has arrived; the number of children that were fit to stay."""

    def admit(solution: Packing) -> bool:
        worst = max(range(len(population)), key=lambda p: population[p].fitness)
        fit = solution.fitness < population[worst].fitness
        if fit:
            population[worst] = solution
        return fit

    if migrant is not None:
        admit(migrant)
    stayed = 0
    for _ in range(CROSSOVERS):
        i, j = rng.choice(len(population), 2, replace=False)
        stayed += admit(crossover(population[i], population[j], length, capacity, rng))
    return stayed


def _elite(population: list[Packing]) -> Packing:
    return min(population, key=lambda s: s.fitness)


def _rng(seed: int, island: int, turn: int) -> np.random.Generator:
    return np.random.default_rng([seed, island, turn])


def evolve(length: np.ndarray, capacity: int, seed: int) -> Packing:
    """Best packing of one shard, all its islands in this process: what the tasks of `pack` do together."""
    islands = [first_population(length, capacity, i, _rng(seed, i, 0)) for i in range(ISLANDS)]
    arrived: list[Packing | None] = [None] * ISLANDS
    for turn in range(1, EPOCHS + 1):
        for i, population in enumerate(islands):
            epoch(population, arrived[i], length, capacity, _rng(seed, i, turn))
        elites = [_elite(population) for population in islands]
        arrived = [elites[i - 1] for i in range(ISLANDS)]
    return min(elites, key=lambda s: s.fitness)


ISLAND = "shard int, island int, kind int, blob binary"
PLACED = "uid string, length bigint, shard int, done boolean, sequence bigint, offset bigint"
OWN, MIGRANT = 0, 1


def _island_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*[(s, i, kind, pickle.dumps(x, protocol=5)) for s, i, kind, x in rows], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["shard", "island", "kind", "blob"])


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(values of the columns, rows) of each group of rows that are sorted by the columns."""
    held: list[pa.Table] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        key = np.stack([table.column(c).to_numpy() for c in columns])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), table.num_rows]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            name = tuple(key[:, lo].tolist())
            if name != now and held:
                yield now, pa.concat_tables(held)
                held = []
            now = name
            held.append(table.slice(lo, hi - lo))
    if held:
        yield now, pa.concat_tables(held)


def _settled(length: np.ndarray, best: Packing, last: bool, most: int) -> np.ndarray:
    """Which items' bins are final: below the last level the loosest bins, of at most `most` items, stay open."""
    if last:
        return np.ones(len(length), bool)
    size = np.bincount(best.bin_of, minlength=len(best.room))
    loosest = np.argsort(-best.room, kind="stable")
    open_ = loosest[(best.room[loosest] > NEARLY) & (np.cumsum(size[loosest]) <= most)]
    final = np.ones(len(best.room), bool)
    final[open_] = False
    return final[best.bin_of]


def _level(open_rows: DataFrame, shards: int, capacity: int, level: int) -> DataFrame:
    """PLACED rows of one level, from (uid, length, shard)."""
    last = shards == 1
    most = max(LEAST_PASSED, SHARD_PIECES // MERGE)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in _grouped(batches, ["shard"]):
            length = rows.column("length").to_numpy().astype(np.int32)
            for i in range(ISLANDS):  # the first island's row carries the names
                yield _island_rows([(shard, i, OWN, (length, rows.column("uid").to_pylist() if i == 0 else None, None))])

    def turn_of(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (shard, island), rows in _grouped(batches, ["shard", "island"]):
                got = dict(zip(rows.column("kind").to_pylist(), rows.column("blob").to_pylist(), strict=True))
                length, names, made = pickle.loads(got[OWN])
                seed = shard * 64 + level
                if made is None:
                    population = first_population(length, capacity, island, _rng(seed, island, 0))
                else:
                    population = [Packing(b.astype(np.int64), r, capacity) for b, r in made]
                migrant = pickle.loads(got[MIGRANT]) if MIGRANT in got else None
                epoch(population, migrant and Packing(migrant[0].astype(np.int64), migrant[1], capacity), length, capacity, _rng(seed, island, turn))
                packed = [(s.bin_of.astype(np.int32), s.room) for s in population]
                best = _elite(population)
                if turn < EPOCHS:
                    yield _island_rows([(shard, island, OWN, (length, names, packed)), (shard, (island + 1) % ISLANDS, MIGRANT, (best.bin_of.astype(np.int32), best.room))])
                else:
                    yield _island_rows([(shard, island, OWN, (length, names, [(best.bin_of.astype(np.int32), best.room)]))])

        return run

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), rows in _grouped(batches, ["shard"]):
            got = [pickle.loads(b) for b in rows.column("blob").to_pylist()]
            length = got[0][0].astype(np.int64)
            names = next(n for _, n, _ in got if n is not None)
            best = _elite([Packing(b.astype(np.int64), r, capacity) for _, _, [(b, r)] in got])
            order = np.argsort(best.bin_of, kind="stable")
            before = np.cumsum(length[order]) - length[order]
            first = np.searchsorted(best.bin_of[order], best.bin_of[order], "left")
            offset = np.zeros(len(length), np.int64)
            offset[order] = before - before[first]
            sequence = (level << 57) + (shard << 25) + best.bin_of
            columns = [pa.array(names, pa.string()), pa.array(length), pa.array(np.full(len(length), shard, np.int32)), pa.array(_settled(length, best, last, most)), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "length", "shard", "done", "sequence", "offset"])

    dealt = open_rows.repartitionById(min(TASKS, shards), F.col("shard")).sortWithinPartitions("shard", "uid").mapInArrow(begin, ISLAND)
    for turn in range(1, EPOCHS + 1):
        task = (F.col("shard") * ISLANDS + F.col("island")) % TASKS
        dealt = dealt.repartitionById(min(TASKS, shards * ISLANDS), task).sortWithinPartitions("shard", "island", "kind").mapInArrow(turn_of(turn), ISLAND)
    return dealt.repartitionById(min(TASKS, shards), F.col("shard")).sortWithinPartitions("shard", "island").mapInArrow(finish, PLACED)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (uid, length, ...) with sequence_id and offset; every length is 1 to capacity."""
    others = [c for c in rows.columns if c not in ("uid", "length")]
    total = rows.count()
    shards = max(1, -(-total // SHARD_PIECES))
    open_rows = rows.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard"))
    placed, level = [], 0
    while True:
        step = keep(_level(open_rows, shards, capacity, level), "packing")
        placed.append(step.where("done").select("uid", "sequence", "offset"))
        if shards == 1:
            break
        shards = -(-shards // MERGE)
        open_rows = step.where("not done").select("uid", "length", F.floor(F.col("shard") / MERGE).cast("int").alias("shard"))
        level += 1
    found = placed[0]
    for more in placed[1:]:
        found = found.unionByName(more)
    return rows.join(found, "uid").select("uid", "length", *others, F.col("sequence").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids] of every piece of every row."""
    made = pieces(text_frame(docs), path, capacity, with_ids)
    # equal rows of one task differ in salt and those of two tasks in the partition that made them
    named = made.withColumn("uid", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece", F.spark_partition_id(), "salt"))
    rows = keep(named.drop("salt"), "pieces")
    full = rows.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    rest = pack(rows.where(F.col("length") < capacity), capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return full.select(*names).unionByName(rest.select(*names))

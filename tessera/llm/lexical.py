"""Ranked lexical search by Block-Max WAND over an inverted index.

The index is dealt by documents: each task turns the texts that it reads into
shards of bounded size, so texts are never shuffled. A shard has a posting list
for each of its terms, cut into blocks of 128 postings: gaps and frequencies as
variable-length bytes, and outside of them the block's first and last document
and its maximum impact. A search moves over blocks without opening them: block
bounds, added up along the documents, are what the lists can give at most at
each document. The pivot is the next document whose bound reaches the
threshold; everything before it is passed over, and from it on, a window at a
time, only blocks that hold a document with such a bound are decompressed. The
threshold is the k-th best score so far, and for most shards at least that of
the shards searched first. Pruning loses no document, ties included.

Query items meet every shard in groups of bounded size, sent whole.

Defined cases: null texts have no terms; a document or item without terms ranks
nowhere; rows that repeat a doc_id are documents each, a null doc_id is ranked
after others of its score; rows that repeat an item_id form one item, with all
their terms; texts are handled whole, a text over the shard's size being a
shard of its own; terms are told apart by a non-linear 64-bit hash; empty
tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import LOWER, blocks, bounded_batches, per_text, span_words, word_spans
from tessera.session import keep

#: Bytes that no term holds: ASCII other than letters and digits.
BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
BLOCK = 128
#: Bytes of text and documents of a shard; documents of a window of the search.
SHARD_BYTES, SHARD_DOCS, WINDOW = 16 << 20, 32_768, 2048
#: Bytes of (item, term, weight) rows that are sent to all tasks at a time.
SENT_BYTES = 64 << 20
#: One of so many shards is searched first, for the others' thresholds.
FIRST = 16
SHARD_SCHEMA = "shard string, doc_ids array<bigint>, sizes binary, terms binary, counts binary, firsts binary, lasts binary, tops binary, starts binary, postings binary"
HITS = "item_id bigint, doc_id bigint, score bigint"


def _texts(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(table.sparkSession)
    return table.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each term occurrence, in order."""
    low = LOWER[data]
    start, end, text = word_spans(low, at, BREAK)
    return span_words(low, start, end)[0].view(np.int64), text


def _counted(terms: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (term, text) with their frequencies, by term, then text; texts come in order."""
    order = np.argsort(terms, kind="stable")
    terms, texts = terms[order], texts[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(terms)), bool), (terms[1:] != terms[:-1]) | (texts[1:] != texts[:-1])]))
    return terms[new], texts[new], np.diff(np.concatenate([new, [len(terms)]]))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int]:
    """The number of documents with terms, and of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in blocks(batches):
            sizes = np.bincount(word_spans(data, at, BREAK)[2], minlength=len(at) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])], ["n", "size"])

    n, size = _texts(docs, id_col, text_col).mapInArrow(run, "n bigint, size bigint").agg(F.sum("n"), F.sum("size")).first()
    return n or 0, size or 0


def norms(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 25 + (25 * size * N) div L of each document."""
    if len(sizes) and 25 * int(sizes.max()) * n_docs >= 1 << 63:
        return np.array([75 + 25 * int(s) * n_docs // n_terms for s in sizes], np.int64)
    return 75 + 25 * sizes.astype(np.int64) * n_docs // max(1, n_terms)


def impacts(frequencies: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * frequencies // (1000 * frequencies + 12 * norm)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative values as bytes of seven bits, low ones first, the last without its high bit; and each value's offset."""
    width = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        width += values >> bits > 0
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(width.max(initial=0))):
        has = np.flatnonzero(width > k)
        out[at[has] + k] = (values[has] >> 7 * k & 127) | np.where(width[has] > k + 1, 128, 0)
    return out, at


def unpacked(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    begins = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(data)]])))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begins)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + sizes[i] - 1 of all i, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class _Building:
    """One shard's postings as they come."""

    def __init__(self):
        self.bytes, self.ids, self.sizes, self.parts = 0, [], [], []

    def add(self, ids: list, data: np.ndarray, at: np.ndarray) -> None:
        terms, texts = _terms(data, at)
        self.sizes.append(per_text(np.ones(len(texts), np.int64), np.searchsorted(texts, np.arange(len(at)))))
        t, d, f = _counted(terms, texts)
        self.parts.append((t, (d + len(self.ids)).astype(np.int32), f.astype(np.int32)))
        self.ids += ids
        self.bytes += int(at[-1])

    def row(self, name: str, n_docs: int, n_terms: int) -> pa.RecordBatch:
        sizes = np.concatenate(self.sizes)
        terms, docs, tf = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.parts = []
        order = np.argsort(terms, kind="stable")
        terms, docs, tf = terms[order], docs[order].astype(np.int64), tf[order].astype(np.int64)
        lists = np.flatnonzero(np.concatenate([np.ones(min(1, len(terms)), bool), terms[1:] != terms[:-1]]))
        counts = np.diff(np.concatenate([lists, [len(terms)]]))
        in_list = np.arange(len(terms)) - np.repeat(lists, counts)
        begins = np.flatnonzero(in_list % BLOCK == 0)
        ends = np.concatenate([begins[1:], [len(terms)]]) if len(begins) else begins
        gaps = np.diff(docs, prepend=0)
        gaps[begins] = 0
        data, at = packed(np.stack([gaps, tf], axis=1).ravel())
        tops = np.maximum.reduceat(impacts(tf, norms(sizes, n_docs, n_terms)[docs]), begins) if len(begins) else begins
        arrays = [sizes.astype("<i8"), terms[lists].astype("<i8"), counts.astype("<i4"), docs[begins].astype("<i4"), docs[ends - 1].astype("<i4") if len(ends) else np.zeros(0, "<i4"), tops.astype("<i4"), at[2 * begins].astype("<i8"), data]
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([self.ids], pa.list_(pa.int64())), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], [f.split()[0] for f in SHARD_SCHEMA.split(", ")])


def build(docs: DataFrame, n_docs: int, n_terms: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of the index of all rows, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, shard = TaskContext.get().partitionId(), 0, _Building()
        for batch, data, at in blocks(batches):
            shard.add(batch.column(0).to_pylist(), data, at)
            if shard.bytes >= SHARD_BYTES or len(shard.ids) >= SHARD_DOCS:
                yield shard.row(f"{task}-{made}", n_docs, n_terms)
                made, shard = made + 1, _Building()
        if shard.ids:
            yield shard.row(f"{task}-{made}", n_docs, n_terms)

    return keep(_texts(docs, id_col, text_col).mapInArrow(run, SHARD_SCHEMA), "shards")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, n) of all items, terms as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in blocks(batches):
            terms, texts, n = _counted(*_terms(data, at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(texts)), pa.array(terms), pa.array(n)], ["item_id", "term", "n"])

    return _texts(items, id_col, text_col).mapInArrow(run, "item_id bigint, term bigint, n bigint").groupBy("item_id", "term").agg(F.sum("n").alias("n"))


def document_frequencies(shards: DataFrame, asked: DataFrame) -> DataFrame:
    """(term, df) of the asked terms that occur; only the shards' dictionaries are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                t, c = np.frombuffer(terms.as_buffer(), "<i8"), np.frombuffer(counts.as_buffer(), "<i4")
                for lo in range(0, len(t), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(t[lo : lo + 100_000]), pa.array(c[lo : lo + 100_000].astype(np.int64))], ["term", "df"])

    return shards.select("terms", "counts").mapInArrow(run, "term bigint, df bigint").join(asked, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))


class Shard:
    """A shard read for searches: blocks stay packed until one is asked for, then stay open."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids = pa.array(row["doc_ids"], pa.int64())
        self.order = np.array([np.iinfo(np.int64).max if i is None else i for i in row["doc_ids"]], np.int64)
        self.norm = norms(get("sizes", "<i8"), n_docs, n_terms)
        self.terms, self.counts = get("terms", "<i8"), get("counts", "<i4").astype(np.int64)
        self.first, self.last, self.top = (get(n, "<i4").astype(np.int64) for n in ("firsts", "lasts", "tops"))
        self.data = get("postings", np.uint8)
        self.start = np.concatenate([get("starts", "<i8"), [len(self.data)]])
        per_list = -(-self.counts // BLOCK)
        self.blocks = np.concatenate([[0], np.cumsum(per_list)])
        size = np.full(len(self.first), BLOCK, np.int64)
        if len(size):
            size[self.blocks[1:] - 1] = self.counts - BLOCK * (per_list - 1)
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.doc, self.impact = np.zeros(self.at[-1], np.int32), np.zeros(self.at[-1], np.int32)
        self.open = np.zeros(len(size), bool)

    def decompress(self, which: np.ndarray) -> None:
        which = which[~self.open[which]]
        if not len(which):
            return
        values = unpacked(self.data[spread(self.start[which], self.start[which + 1] - self.start[which])])
        gaps, tf = values[::2], values[1::2]
        size = self.at[which + 1] - self.at[which]
        begins = np.cumsum(size) - size
        gaps[begins] = self.first[which]
        total = np.cumsum(gaps)
        docs = total - np.repeat(total[begins] - self.first[which], size)
        where = spread(self.at[which], size)
        self.doc[where], self.impact[where] = docs, impacts(tf, self.norm[docs])
        self.open[which] = True

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Documents, by their number here, and scores: all of the k best that score at least floor, best first."""
        none = np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        here = np.flatnonzero(self.terms[place] == terms) if len(self.terms) else none
        lists = place[here]
        n_blocks = self.blocks[lists + 1] - self.blocks[lists]
        which = spread(self.blocks[lists], n_blocks)
        weight = np.repeat(weights[here], n_blocks)
        # the shallow moves of all lists: what their blocks can give at most, at each document
        step = np.zeros(len(self.order) + 1, np.int64)
        np.add.at(step, self.first[which], weight * self.top[which])
        np.subtract.at(step, self.last[which] + 1, weight * self.top[which])
        bound = np.cumsum(step)[:-1]
        best, scores, pivot = none, none, 0
        while True:
            reach = np.flatnonzero(bound[pivot:] >= floor)
            if not len(reach):
                return best, scores
            pivot += int(reach[0])
            end = min(len(bound), pivot + WINDOW)
            alive = bound[pivot:end] >= floor
            upto = np.concatenate([[0], np.cumsum(alive)])
            inside = np.flatnonzero((self.first[which] < end) & (self.last[which] >= pivot))
            lo, hi = np.maximum(self.first[which[inside]], pivot) - pivot, np.minimum(self.last[which[inside]] + 1, end) - pivot
            inside = inside[upto[hi] > upto[lo]]
            used = which[inside]
            self.decompress(used)
            size = self.at[used + 1] - self.at[used]
            postings = spread(self.at[used], size)
            docs = self.doc[postings].astype(np.int64) - pivot
            gains = np.repeat(weight[inside], size) * self.impact[postings]
            fits = (docs >= 0) & (docs < end - pivot)
            got = np.zeros(end - pivot, np.int64)
            np.add.at(got, docs[fits], gains[fits])
            found = np.flatnonzero(alive & (got >= floor))
            best, scores = np.concatenate([best, found + pivot]), np.concatenate([scores, got[found]])
            order = np.lexsort([best, self.order[best], -scores])[:k]
            best, scores = best[order], scores[order]
            if len(best) == k:
                floor = max(floor, int(scores[-1]))
            pivot = end


def _groups(weighed: DataFrame) -> Iterator[dict]:
    """The items' terms and weights in groups of about SENT_BYTES, each small enough to send to every task."""
    n = weighed.count()
    parts = max(1, -(-n * 24 // SENT_BYTES))
    for part in range(parts):
        rows = weighed.where(F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(0))), F.lit(parts)) == part).toArrow()
        order = rows.sort_by([("item_id", "ascending"), ("term", "ascending")])
        group: dict = {}
        terms, weights = order.column("term").to_numpy(), order.column("weight").to_numpy()
        items = order.column("item_id").to_pylist()
        cuts = [0, *[i for i in range(1, len(items)) if items[i] != items[i - 1]], len(items)] if items else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            group[items[a]] = (terms[a:b], weights[a:b])
        yield group


def _searched(shards: DataFrame, group, floors, k: int, n_docs: int, n_terms: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SHARD_SCHEMA.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(c)[i].as_py() if n == "doc_ids" else batch.column(c)[i].as_buffer() if c else None for c, n in enumerate(names)}
                shard = Shard(row, n_docs, n_terms)
                items, docs, scores = [], [], []
                for item, (terms, weights) in group.value.items():
                    found, got = shard.search(terms, weights, k, floors.value.get(item, 1))
                    items += [item] * len(found)
                    docs.append(found)
                    scores.append(got)
                if items:
                    yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), shard.ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], ["item_id", "doc_id", "score"])

    return shards.mapInArrow(run, HITS)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item, equal scores by doc_id."""
    spark = docs.sparkSession
    n_docs, n_terms = statistics(docs, id_col, text_col)
    shards = build(docs, n_docs, n_terms, id_col, text_col)
    asked = keep(item_terms(items, item_col, text_col), "item-terms")
    known = document_frequencies(shards, asked.select("term").distinct())
    idf = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighed = keep(asked.join(known, "term").select("item_id", "term", (idf * F.col("n")).alias("weight")).where("weight > 0"), "weighed")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    early = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
    out = None
    for group in _groups(weighed):
        sent = spark.sparkContext.broadcast(group)
        first = keep(_searched(shards.where(early), sent, spark.sparkContext.broadcast({}), k, n_docs, n_terms), "first-hits")
        # at most one row for each item of the group
        floors = {r["item_id"]: r["score"] for r in ranked(first).where(F.col("rank") == k).collect()}
        hits = first.unionByName(_searched(shards.where(~early), sent, spark.sparkContext.broadcast(floors), k, n_docs, n_terms))
        out = hits if out is None else out.unionByName(hits)
    return ranked(out).select("item_id", "rank", "doc_id", "score")

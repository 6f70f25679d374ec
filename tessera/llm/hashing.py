"""Approximate nearest neighbours by multi-index hashing.

Binary codes come from rotations learned on a bounded sample (the SAMPLE rows
with the smallest id hashes): principal axes, then iterative quantisation;
several rotations are learned where the dimension is smaller than the code.
Each shard keeps one table for each 16-bit substring, and each table is
probed up to its threshold; the thresholds add up to the radius less the
number of tables but one, so that by pigeonhole every code within the radius
is met by some table. These codes are compared in full and reranked by exact
cosine.

The radius covers COVERED of the sample queries' true neighbours in the
sample, which lie farther than those among all rows. While a query has fewer
than k codes within it, it grows by one bit a table, by the same probing.

Defined cases: those of `vectors`, empty tables and clashing names among them;
zero vectors take no part; equal cosines go to the smaller vec_id; of fewer
candidates than k all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import search, usable

BITS, SUB = 256, 16
SAMPLE, SAMPLE_QUERIES, COVERED, ROUNDS = 4096, 256, 0.97, 25
_COUNT = np.bitwise_count(np.arange(1 << SUB, dtype=np.uint16))
#: All values of a substring by their number of ones, and how many have at most so many.
_NEAREST = np.argsort(_COUNT, kind="stable").astype(np.uint16)
_WITHIN = np.cumsum(np.bincount(_COUNT))


def unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def cosine(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each row summed the same way wherever it stands."""
    return (rows * q).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((q * q).sum()))


class Codes:
    """Learned rotations and the probing radius for one dimension."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 3):
        x, rng = unit(sample), np.random.default_rng(seed)
        self.mean = x.mean(0)
        centered, dim = x - self.mean, x.shape[1]
        _, axes = np.linalg.eigh(centered.T @ centered)
        self.planes = []
        while sum(p.shape[1] for p in self.planes) < BITS:
            width = min(dim, BITS - sum(p.shape[1] for p in self.planes))
            base = axes[:, ::-1] if not self.planes else axes @ np.linalg.qr(rng.normal(size=(dim, dim)))[0]
            base = base[:, :width]
            turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
            low = centered @ base
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
                turn = (u @ v).T
            self.planes.append(base @ turn)
        self.planes = np.column_stack(self.planes)
        codes = self.encode(sample)
        far = []
        for i in range(0, len(x), max(1, len(x) // SAMPLE_QUERIES)):
            near = np.argsort(-(x @ x[i]), kind="stable")[: k + 1]
            far.extend(np.bitwise_count(codes[near[near != i]] ^ codes[i]).sum(1).tolist())
        self.radius = int(np.ceil(np.quantile(far, COVERED))) if far else BITS

    def encode(self, rows: np.ndarray) -> np.ndarray:
        bits = (unit(rows) - self.mean) @ self.planes >= 0
        return np.packbits(bits, axis=1).view(np.uint16)


def thresholds(radius: int, tables: int) -> list[int]:
    """How far each table is probed. Of all codes within the radius at least one substring is as near as its table's threshold.

    Were every substring farther, the distances would add up to more than the radius. A table with -1 is not probed.
    """
    spare = radius - tables + 1
    return [max(-1, spare // tables + (s < spare % tables)) for s in range(tables)]


class MultiIndex:
    """One shard: codes, a table for each substring, and the vectors for the rerank."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, codes: Codes):
        self.ids, self.rows, self.codes = ids, rows, codes.encode(rows)
        self.radius = codes.radius
        self.asked_by = codes
        # for each substring: rows in order of its value, where each value begins, and the values that occur
        self.tables = []
        for s in range(self.codes.shape[1]):
            count = np.bincount(self.codes[:, s], minlength=1 << SUB)
            begin = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            self.tables.append((np.argsort(self.codes[:, s], kind="stable").astype(np.int32), begin, np.flatnonzero(count).astype(np.uint16)))

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that some table holds near enough: by looking up every neighbouring value, or those that occur if they are fewer."""
        hit = np.zeros(len(self.ids), bool)
        for s, reach in enumerate(thresholds(radius, len(self.tables))):
            if reach < 0:
                continue
            rows, begin, present = self.tables[s]
            if _WITHIN[reach] < len(present):
                near = _NEAREST[: _WITHIN[reach]] ^ code[s]
            else:
                near = present[_COUNT[present ^ code[s]] <= reach]
            size = begin[near.astype(np.int64) + 1] - begin[near]
            near, size = near[size > 0], size[size > 0]
            hit[rows[np.repeat(begin[near] - (np.cumsum(size) - size), size) + np.arange(size.sum())]] = True
        return np.flatnonzero(hit)

    def within(self, code: np.ndarray, radius: int | None = None) -> np.ndarray:
        """Rows whose code lies within the radius."""
        radius = self.radius if radius is None else radius
        found = self.probed(code, radius)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(1) <= radius]

    def nearest(self, query_id: int, row: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of all codes within the radius, which grows while it holds fewer than k and is not all."""
        radius = self.radius
        while True:
            found = self.within(code, radius)
            found = found[self.ids[found] != query_id]
            if len(found) >= k or radius >= BITS:
                break
            radius += len(self.tables)
        score = cosine(self.rows[found], row)
        best = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found][best], score[best]


def learn(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> dict[int, Codes]:
    """Codes by dimension, from at most SAMPLE rows."""
    rows = usable(vectors, id_col, vector_col, nonzero=True)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    dims, flat = sample.column("dim").to_numpy(), sample.column("v").to_pylist()
    return {int(d): Codes(np.array([v for v, e in zip(flat, dims, strict=True) if e == d]), k) for d in set(dims.tolist())}


def approximate(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (cosine) for each row whose id `every` divides."""
    codes = learn(vectors, k, id_col, vector_col)

    def make(ids: np.ndarray, rows: np.ndarray) -> MultiIndex:
        own = codes.get(rows.shape[1]) or Codes(rows[:SAMPLE], k)  # a dimension too rare for the sample
        return MultiIndex(ids, rows, own)

    def probe(index: MultiIndex, ids: np.ndarray, rows: np.ndarray, floors: dict[int, float]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for query, row, code in zip(ids.tolist(), rows, index.asked_by.encode(rows), strict=True):
            found, scores = index.nearest(query, row, code, k)
            yield query, found, scores

    return search(vectors, F.col("vec_id") % every == 0, k, make, probe, "double", id_col, vector_col, nonzero=True)

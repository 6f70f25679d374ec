"""Exact top-k inner products by M-tree best-first search.

Largest inner product becomes nearest neighbour in a metric: a vector x of a
shard is extended by sqrt(M^2 - |x|^2), with M the shard's largest norm, and a
query by 0, so that squared distance is |q|^2 + M^2 - 2 q.x. The tree is
bulk-loaded into pages; each routing entry keeps its pivot, covering radius
and distance to the parent's pivot, each leaf entry its distance to the leaf's
pivot. The search takes pages in order of their least possible distance, skips
entries whose stored distances already exclude them, and ends when no page can
hold a better entry; it begins with the bound that the first shard has found.
Scores are exact integers.

Defined cases: those of `vectors`, empty tables and clashing names among them;
equal scores go to the smaller vec_id; fewer candidates than k are all
returned; a shard's search orders scores of any size, and those beyond a long
are returned as the largest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import search

PAGE, FANOUT, SCALE = 64, 32, 1024
_LONG = (1 << 63) - 1


def to_integers(rows: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x); Python integers if they are too large for exact doubles."""
    scaled = np.floor(rows * float(scale))
    if scaled.size and np.abs(scaled).max() >= 2.0**53:
        return np.array([[int(x) for x in row] for row in scaled.tolist()], object)
    return scaled.astype(np.int64)


def exact_dot(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; through doubles or longs only where these are exact."""
    if rows.dtype != object and q.dtype != object and rows.size:
        bound = float(np.abs(rows).max()) * float(np.abs(q).max()) * rows.shape[1]
        if bound < 2.0**52:
            return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        if bound < 2.0**62:
            return rows @ q
    out = np.empty(len(rows), object)
    out[:] = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in rows]
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, equal ones by id; scores may be integers beyond a long."""
    if scores.dtype == object:
        best = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
    else:
        best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


class Node:
    __slots__ = ("children", "entries", "pivot", "radius", "to_parent", "to_pivot", "pivots", "radii", "to_self")

    def __init__(self, pivot: int, to_parent: float):
        self.pivot, self.to_parent, self.radius = pivot, to_parent, 0.0
        self.children: list[Node] = []
        self.entries = self.to_pivot = None


class MTree:
    """Over the rows of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.exact = ids, to_integers(rows)
        plain = self.exact.astype(np.float64)
        norm = (plain**2).sum(1)
        self.most = float(norm.max()) if len(ids) else 0.0
        self.points = np.column_stack([plain, np.sqrt(np.maximum(self.most - norm, 0))])
        self.root = self._load(np.arange(len(ids)), None) if len(ids) else None

    def _distances(self, at: np.ndarray, pivot: int) -> np.ndarray:
        return np.sqrt(((self.points[at] - self.points[pivot]) ** 2).sum(1))

    def _load(self, at: np.ndarray, parent: int | None, pivot: int | None = None) -> Node:
        pivot = int(at[0]) if pivot is None else pivot
        to_parent = 0.0 if parent is None else float(self._distances(np.array([pivot]), parent)[0])
        node = Node(pivot, to_parent)
        distance = self._distances(at, pivot)
        node.radius = float(distance.max())
        if len(at) <= PAGE:
            node.entries, node.to_pivot = at, distance
            return node
        seeds = at[np.linspace(0, len(at) - 1, min(FANOUT, -(-len(at) // PAGE))).astype(int)]
        if node.radius > 0:
            owner = np.argmin(np.stack([self._distances(at, s) for s in seeds]), 0)
        if node.radius == 0 or np.bincount(owner).max() == len(at):  # equal points: pages of any members
            owner = np.arange(len(at)) * len(seeds) // len(at)
        for s in range(len(seeds)):
            own = at[owner == s]
            if len(own):
                node.children.append(self._load(own, pivot, int(seeds[s]) if seeds[s] in own else int(own[0])))
        node.pivots = np.array([c.pivot for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        node.to_self = np.array([c.to_parent for c in node.children])
        return node

    def nearest(self, query_id: int, raw: np.ndarray, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best (vec_ids, scores) other than query_id itself; those under a floor may be left out."""
        q = to_integers(raw[None])[0]
        point = np.append(q.astype(np.float64), 0.0)
        slack = 1e-9 * (1 + float((point**2).sum()) + self.most) ** 0.5 + 1e-6
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        base = float((point**2).sum()) + self.most
        # a score of a long's end may stand for a larger one, and so bounds nothing
        limit = max(0.0, base - 2.0 * float(floor)) ** 0.5 if floor is not None and abs(floor) < _LONG else np.inf

        def reach(at: np.ndarray) -> np.ndarray:
            return np.sqrt(((self.points[at] - point) ** 2).sum(1))

        first = float(reach(np.array([self.root.pivot]))[0])
        queue, turn = [(max(0.0, first - self.root.radius), 0, first, self.root)], 1
        while queue:
            bound, _, to_pivot, node = heapq.heappop(queue)
            if bound > limit + slack:
                break
            if node.entries is not None:
                maybe = node.entries[np.abs(to_pivot - node.to_pivot) <= limit + slack]
                maybe = maybe[self.ids[maybe] != query_id]
                if len(maybe):
                    ids = np.concatenate([ids, self.ids[maybe]])
                    scores = np.concatenate([scores, exact_dot(self.exact[maybe], q)])
                    ids, scores = best_of(ids, scores, k)
                    if len(ids) == k:
                        limit = min(limit, max(0.0, base - 2.0 * float(scores[-1])) ** 0.5)
                continue
            maybe = np.flatnonzero(np.abs(to_pivot - node.to_self) - node.radii <= limit + slack)
            if len(maybe):
                away = reach(node.pivots[maybe])
                for c, d in zip(maybe.tolist(), away.tolist(), strict=True):
                    least = max(0.0, d - node.radii[c], abs(to_pivot - node.to_self[c]) - node.radii[c])
                    if least <= limit + slack:
                        heapq.heappush(queue, (least, turn, d, node.children[c]))
                        turn += 1
        if scores.dtype == object:
            scores = np.array([min(_LONG, max(-_LONG, x)) for x in scores], np.int64)
        return ids, scores


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each row whose id `every` divides."""

    def probe(tree: MTree, ids: np.ndarray, rows: np.ndarray, floors: dict[int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for query, row in zip(ids.tolist(), rows, strict=True):
            found, scores = tree.nearest(query, row, k, floors.get(query))
            yield query, found, scores

    return search(vectors, F.col("vec_id") % every == 0, k, MTree, probe, "bigint", id_col, vector_col)

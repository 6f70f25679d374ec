"""The main text of HTML pages, by a recurrent labeller of leaf blocks.

Each page becomes its sequence of leaf blocks (`leaves.py`). A block is read as
a tag-path vector (the mean embeddings of the hashed names around it, and of
the innermost ones), a hashed-word vector (the mean embedding of its words) and
a few counts, and a
bidirectional LSTM in numpy labels every block with the whole page as context:
article, or rest. It is trained once in a process, by gradient descent through
time, on pages drawn by seed in many layouts (`sample_pages.py`); weights of
about 100 KB go to all tasks. Pages never meet, so nothing is shuffled.

Defined cases: null and empty pages, and pages without article blocks, give
empty text; repeated rows are pages each; a null page_id or url is kept; long
pages are labelled whole; broken markup is read as far as it goes; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import LOWER, bounded_batches, per_text, span_words, word_spans
from tessera.llm.leaves import Leaf, leaves
from tessera.llm.sample_pages import MAIN, REST, pages

#: Rows of the two embedding tables, their widths, the number of counts, and hidden units a direction.
NAMES, WORDS, NAME_WIDTH, WORD_WIDTH, COUNTS, HIDDEN = 2048, 1024, 20, 12, 9, 24
TRAINING_PAGES, EPOCHS, BATCH, RATE, SEED = 1600, 9, 32, 0.009, 7
#: The embedded parts of a block's input, with their columns.
EMBEDDED = {"path": (0, NAME_WIDTH), "near": (NAME_WIDTH, 2 * NAME_WIDTH), "words": (2 * NAME_WIDTH, 2 * NAME_WIDTH + WORD_WIDTH)}
#: Blocks, padding included, that are labelled at a time; a longer page makes a group of its own.
GROUP_BLOCKS = 20_000
SCHEMA = "page_id bigint, url string, text string, n_chars bigint"


def _counts(page: list[Leaf], data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length, links, marks, digits, capitals, sentence end, and place of each block."""
    size = np.diff(at).astype(np.float64)
    share = lambda mask: per_text(mask, at) / size
    n = len(page)
    ends = np.isin(data[at[1:] - 1], np.frombuffer(b".!?:\"'", np.uint8))
    marks = np.isin(data, np.frombuffer(b".,;:!?", np.uint8))
    place = (np.arange(n) + 0.5) / n
    linked = np.array([leaf.linked / len(leaf.text) for leaf in page])
    return np.stack([np.log1p(size) / 5, linked, 10 * share(marks), 5 * share((data >= 48) & (data < 58)), 5 * share((data >= 65) & (data < 91)), ends, place, np.full(n, np.log1p(n) / 5), per_text(marks, at) > 1], axis=1)


def _hashed(names: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray]:
    known: dict[tuple, list[int]] = {}
    out, at = [], [0]
    for group in names:
        if group not in known:
            known[group] = [zlib.crc32(n.encode()) % NAMES for n in group]
        out += known[group]
        at.append(len(out))
    return np.array(out, np.int64), np.array(at)


class Encoded:
    """One page's blocks as numbers."""

    def __init__(self, page: list[Leaf]):
        self.n = len(page)
        self.path, self.path_at = _hashed([leaf.path for leaf in page])
        self.near, self.near_at = _hashed([leaf.near for leaf in page])
        raw = [leaf.text.encode() for leaf in page]
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        low = LOWER[data]
        start, end, text = word_spans(low, at)
        self.words = (span_words(low, start, end)[0] % np.uint64(WORDS)).astype(np.int64)
        self.words_at = np.searchsorted(text, np.arange(self.n + 1))
        self.counts = _counts(page, data, at)


def _mean(table: np.ndarray, rows: np.ndarray, at) -> np.ndarray:
    at = np.asarray(at)
    size = np.maximum(1, np.diff(at))[:, None]
    total = np.zeros((len(at) - 1, table.shape[1]))
    some = np.flatnonzero(np.diff(at))
    if len(some):
        total[some] = np.add.reduceat(table[rows], at[:-1][some])
    return total / size


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """Embeddings, one LSTM a direction, and a logistic output."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        width = 2 * NAME_WIDTH + WORD_WIDTH + COUNTS
        self.p = {"path": rng.normal(0, 0.3, (NAMES, NAME_WIDTH)), "near": rng.normal(0, 0.3, (NAMES, NAME_WIDTH)), "words": rng.normal(0, 0.1, (WORDS, WORD_WIDTH)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, width**-0.5, (width, 4 * HIDDEN))
            self.p[f"h{d}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])

    def inputs(self, page: Encoded) -> np.ndarray:
        return np.concatenate([*[_mean(self.p[k], getattr(page, k), getattr(page, f"{k}_at")) for k in EMBEDDED], page.counts], axis=1)

    def _run(self, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction over (time, page, ...) inputs, and what its gradient needs."""
        gates, h, c = x @ self.p[f"x{d}"] + self.p[f"c{d}"], np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN))
        out, trace = np.empty((*x.shape[:2], HIDDEN)), []
        for t in range(len(x)):
            a = gates[t] + h @ self.p[f"h{d}"]
            ifo, g = _sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            before, past = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            out[t] = h
            if keep:
                trace.append((i, f, o, g, before, past, squashed))
        return out, trace

    def _back(self, d: str, x: np.ndarray, trace: list, dout: np.ndarray, grad: dict) -> np.ndarray:
        da = np.empty((*x.shape[:2], 4 * HIDDEN))
        dh, dc = np.zeros(dout.shape[1:]), np.zeros(dout.shape[1:])
        weights = self.p[f"h{d}"]
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before, past, squashed = trace[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - squashed**2)
            da[t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            grad[f"h{d}"] += past.T @ da[t]
            dh, dc = da[t] @ weights.T, dc * f
        flat = da.reshape(-1, 4 * HIDDEN)
        grad[f"x{d}"] += x.reshape(-1, x.shape[2]).T @ flat
        grad[f"c{d}"] += flat.sum(axis=0)
        return da @ self.p[f"x{d}"].T

    @staticmethod
    def _padded(inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(time, page, width) forward and backward, and the time of each page's block when read backward."""
        longest = max(len(x) for x in inputs)
        ahead = np.zeros((longest, len(inputs), inputs[0].shape[1]))
        back = np.zeros_like(ahead)
        for k, x in enumerate(inputs):
            ahead[: len(x), k] = x
            back[: len(x), k] = x[::-1]
        return ahead, back, np.array([len(x) for x in inputs])

    def scores(self, batch: list[Encoded]) -> list[np.ndarray]:
        """The log odds of being article, of every block of every page."""
        ahead, back, n = self._padded([self.inputs(p) for p in batch])
        hf, hb = self._run("f", ahead, False)[0], self._run("b", back, False)[0]
        out, half = self.p["out"], HIDDEN
        return [hf[:k, i] @ out[:half] + hb[:k, i][::-1] @ out[half:] + self.p["bias"] for i, k in enumerate(n)]

    def gradient(self, batch: list[Encoded], truth: list[np.ndarray]) -> tuple[float, dict]:
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        inputs = [self.inputs(p) for p in batch]
        ahead, back, n = self._padded(inputs)
        (hf, tf), (hb, tb) = self._run("f", ahead, True), self._run("b", back, True)
        df, db, loss, total = np.zeros_like(hf), np.zeros_like(hb), 0.0, int(n.sum())
        for i, k in enumerate(n):
            both = np.concatenate([hf[:k, i], hb[:k, i][::-1]], axis=1)
            z = both @ self.p["out"] + self.p["bias"]
            loss += float(np.sum(np.logaddexp(0, z) - truth[i] * z)) / total
            dz = (_sigmoid(z) - truth[i]) / total
            grad["out"] += dz @ both
            grad["bias"] += dz.sum()
            df[:k, i], db[:k, i] = np.outer(dz, self.p["out"][:HIDDEN]), np.outer(dz[::-1], self.p["out"][HIDDEN:])
        dx, dy = self._back("f", ahead, tf, df, grad), self._back("b", back, tb, db, grad)
        for i, (page, n_blocks) in enumerate(zip(batch, n, strict=True)):
            d = dx[:n_blocks, i] + dy[:n_blocks, i][::-1]
            for k, (lo, hi) in EMBEDDED.items():
                size = np.diff(getattr(page, f"{k}_at"))
                np.add.at(grad[k], getattr(page, k), np.repeat(d[:, lo:hi] / np.maximum(1, size)[:, None], size, axis=0))
        return loss, grad

    def fit(self, batch: list[Encoded], truth: list[np.ndarray], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
        """Adam over pages in batches of like length, with some words and names left out of each reading."""
        rng = np.random.default_rng(seed)
        first, second, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        order = np.argsort([p.n for p in batch], kind="stable")
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs) + RATE / 20
            for g in rng.permutation(len(groups)):
                grad = self.gradient([_thinned(batch[i], rng) for i in groups[g]], [truth[i] for i in groups[g]])[1]
                step += 1
                norm = max(1.0, float(np.sqrt(sum((v**2).sum() for v in grad.values()))))
                for k, v in grad.items():
                    v = v / norm
                    first[k], second[k] = 0.9 * first[k] + 0.1 * v, 0.99 * second[k] + 0.01 * v**2
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return self


def _thinned(page: Encoded, rng: np.random.Generator, words: float = 0.5, names: float = 0.1) -> Encoded:
    out = object.__new__(Encoded)
    out.n, out.counts = page.n, page.counts
    for rows, odds in (("words", words), ("path", names), ("near", names)):
        stay = rng.random(len(getattr(page, rows))) >= odds
        setattr(out, rows, getattr(page, rows)[stay])
        setattr(out, f"{rows}_at", np.concatenate([[0], np.cumsum(stay)])[getattr(page, f"{rows}_at")])
    return out


def labelled(page: str) -> tuple[Encoded, np.ndarray] | None:
    """A drawn page without its marks, and its blocks' labels."""
    blocks = leaves(page)
    truth = np.array([leaf.text[0] == MAIN for leaf in blocks], np.float64)
    for leaf in blocks:
        leaf.text = leaf.text.replace(MAIN, "").replace(REST, "") or "."
        leaf.linked = min(leaf.linked, len(leaf.text))
    return (Encoded(blocks), truth) if blocks else None


@lru_cache(maxsize=4)
def trained(seed: int = SEED, n_pages: int = TRAINING_PAGES, epochs: int = EPOCHS) -> Labeller:
    """The labeller fitted on drawn pages; at most n_pages of them, so its cost does not grow with the corpus."""
    sample = [x for x in (labelled(p) for p in pages(seed, n_pages)) if x is not None]
    return Labeller(seed).fit([e for e, _ in sample], [t for _, t in sample], epochs)


def main_texts(model: Labeller, htmls: list[str | None]) -> list[str]:
    """The article blocks of each page, joined by line ends."""
    found = [leaves(h) for h in htmls]
    out = [""] * len(htmls)
    order = sorted((i for i, page in enumerate(found) if page), key=lambda i: len(found[i]))
    while order:
        # the longest of a group pads the others
        take = 1
        while take < len(order) and (take + 1) * len(found[order[take]]) <= GROUP_BLOCKS:
            take += 1
        group, order = order[:take], order[take:]
        for i, score in zip(group, model.scores([Encoded(found[i]) for i in group]), strict=True):
            out[i] = "\n".join(leaf.text for leaf, s in zip(found[i], score, strict=True) if s > 0)
    return out


def extract_main(pages_table: DataFrame, model: Labeller | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    spark = pages_table.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(model or trained())
    rows = pages_table.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = main_texts(sent.value, part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, SCHEMA)

"""Quality classifier: a regularised quadratic discriminant over document statistics.

Every whole text becomes a short vector of transformed statistics. Counts,
means and second moments by class are sums over all labelled rows, so fitting
gathers a fixed number of numbers whatever the table's size. Class
covariances shrink towards the pooled one and its diagonal; a score is the
logistic of the difference of the two Mahalanobis log-densities plus the log
prior, with each Cholesky factor computed once.

Defined cases: null and empty texts have the statistics of no words and are
scored like any other; very long texts are measured whole; rows whose label or
id is null teach nothing; a label row or a document that repeats counts as
often as it stands; equal texts score alike; a table without labels of both
classes gives every text the share of label 1 (0.5 if there are none); an
empty table gives an empty result; other columns are ignored, or carried
unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import SPACE, blocks, bounded_batches, crc_mod, per_text, raw_bytes, release, slices, span_words, text_frame, whole_row, word_spans
from tessera.session import keep

FEATURES = ("log_words", "letters", "upper", "digits", "symbols", "stops", "wide", "word_mean", "word_sd", "adjacent", "distinct", "bare", "glued", "capital", "long_words", "line_repeats", "worst_run", "bars")
#: Weight of the pooled covariance and of its diagonal in each class covariance.
POOLED, DIAGONAL = 0.1, 0.05
THRESHOLD = 0.3
_code = np.arange(256)
LETTER = ((_code | 32) >= 97) & ((_code | 32) <= 122) & (_code < 128) | (_code >= 128)
UPPER = (_code >= 65) & (_code <= 90)
DIGIT = (_code >= 48) & (_code <= 57)
STOP = np.isin(_code, [46, 44, 59, 58, 63, 33])
SYMBOL = (_code > 32) & (_code < 127) & ~LETTER & ~DIGIT & ~np.isin(_code, [46, 44, 39, 45])
BAR = np.isin(_code, [124, 60, 62, 123, 125, 91, 93, 92, 95])
WINDOW = 64
#: Bytes and words of ordinary prose that each text's shares start from, so that a number in a short text weighs little.
PRIOR_BYTES, PRIOR_WORDS = 60, 10


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a block."""
    n = len(at) - 1
    size = np.maximum(at[1:] - at[:-1], 1).astype(float)
    start, end, owner = word_spans(data, at)
    words = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = (end - start).astype(float)
    mean = np.bincount(owner, length, n) / some
    sd = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some - mean**2, 0))
    solid = per_text(~SPACE[data], at) + float(PRIOR_BYTES)
    share = lambda kind, usual=0.0: (per_text(kind[data], at) + usual * PRIOR_BYTES) / solid
    by_word = lambda mask: np.bincount(owner[mask], minlength=n) / (words + PRIOR_WORDS)
    hashes = span_words(data, start, end)[0]
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=n)
    letters = np.concatenate([[0], np.cumsum(LETTER[data])])
    in_word = letters[end] - letters[start]
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
    odd = (symbols[end] - symbols[start]) > 0
    capital = UPPER[data[start]] if len(start) else np.zeros(0, bool)
    uppers = np.concatenate([[0], np.cumsum(UPPER[data])])
    shout = (uppers[end] - uppers[start]) >= np.maximum(in_word, 2)
    # worst stretch: the largest share of repeated, symbol-bearing or all-capital words in a run of WINDOW words
    bad = np.concatenate([[0], np.cumsum(same | odd | shout | (in_word == 0))])
    worst = np.zeros(n)
    if len(start):
        first = np.searchsorted(owner, owner, "left")
        lo = np.maximum(np.arange(len(owner)) + 1 - WINDOW, first)
        np.maximum.at(worst, owner, (bad[1:] - bad[lo]) / WINDOW)
    newline = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([at, newline + 1]))
    cuts = cuts[cuts <= at[-1]]
    left, right = cuts[:-1], cuts[1:]
    keep_line = right - left > 20
    left, right = left[keep_line], right[keep_line]
    line_owner = np.searchsorted(at, left, "right") - 1
    line_hash = span_words(data, left, np.where(data[right - 1] == 10, right - 1, right))[0] if len(left) else np.zeros(0, np.uint64)
    line_order = np.lexsort((line_hash, line_owner))
    again = np.zeros(len(left), bool)
    again[1:] = (line_hash[line_order][1:] == line_hash[line_order][:-1]) & (line_owner[line_order][1:] == line_owner[line_order][:-1])
    repeats = np.bincount(line_owner[line_order][again], minlength=n) / np.maximum(np.bincount(line_owner, minlength=n), 1)
    root = np.sqrt
    return np.column_stack([
        np.log1p(words), share(LETTER, 0.97), root(share(UPPER)), root(share(DIGIT)), root(share(SYMBOL)), root(share(STOP)), root(share(_code >= 128)),
        np.log1p(mean), np.log1p(sd), root(by_word(same)), np.log1p(distinct) / np.log1p(some), root(by_word(in_word == 0)),
        root(by_word(odd)), root(by_word(capital)), root(by_word(length > 25)), root(repeats), root(worst), root(per_text(BAR[data], at) / size),
    ])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in blocks(batches):
            x = statistics(data, at)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, x array<double>")


class Discriminant:
    """Two Gaussian classes with shrunken covariances."""

    def __init__(self, counts, sums, squares, pooled: float = POOLED, diagonal: float = DIAGONAL):
        counts = np.asarray(counts, float)
        self.share = float(counts[1] / counts.sum()) if counts.sum() else 0.5
        self.fitted = bool((counts >= 2).all())
        if not self.fitted:
            return
        total = counts.sum()
        self.center = sums.sum(0) / total
        spread = np.sqrt(np.maximum(np.diagonal(squares.sum(0)) / total - self.center**2, 0))
        self.spread = np.where(spread > 1e-9, spread, 1.0)
        means = (sums / counts[:, None] - self.center) / self.spread
        own = [(squares[c] / counts[c] - np.outer(sums[c], sums[c]) / counts[c] ** 2) / np.outer(self.spread, self.spread) for c in (0, 1)]
        both = (counts[0] * own[0] + counts[1] * own[1]) / total
        self.means, self.factors, self.logdets = means, [], []
        for c in (0, 1):
            cov = (1 - pooled - diagonal) * own[c] + pooled * both + diagonal * np.diag(np.maximum(np.diagonal(both), 1e-3))
            cov[np.diag_indices_from(cov)] += 1e-3
            factor = np.linalg.cholesky(cov)
            self.factors.append(np.linalg.inv(factor))
            self.logdets.append(2 * float(np.log(np.diagonal(factor)).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        z = np.clip((x - self.center) / self.spread, -12, 12)
        log = [-0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(1) - 0.5 * self.logdets[c] for c in (0, 1)]
        margin = log[1] - log[0] + np.log(max(self.share, 1e-9) / max(1 - self.share, 1e-9))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(x: DataFrame, labels: DataFrame) -> Discriminant:
    """From (doc_id, x) and (doc_id, quality); sums over all labelled rows, by Spark."""
    k = len(FEATURES)
    taught = x.join(labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
    at = [F.col("x")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = taught.groupBy("quality").agg(F.count("*").alias("n"), F.array(*[F.sum(a) for a in at]).alias("s"), F.array(*[F.sum(at[i] * at[j]) for i, j in pairs]).alias("q")).collect()
    counts, sums, squares = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
    for row in rows:
        c = row["quality"]
        counts[c], sums[c] = row["n"], row["s"]
        for (i, j), v in zip(pairs, row["q"], strict=True):
            squares[c, i, j] = squares[c, j, i] = v
    return Discriminant(counts, sums, squares)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; labels of the held-out fold are never used."""
    rows = text_frame(docs)
    x = keep(with_statistics(rows), "quality")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where(crc_mod("doc_id", folds) != held_out)
    model = fit(x, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(values))], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns unchanged.

    Statistics are computed once and written beside the rows, so nothing but
    labels and statistics is shuffled.
    """
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("array<double>")
    def measured(text: pa.Array) -> pa.Array:
        data, at = raw_bytes(text)
        found = [statistics(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in slices(at)]
        x = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
        release()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))

    marked = keep(docs.select(whole_row(docs), docs["doc_id"].cast("bigint").alias("doc_id"), measured(docs["text"].cast("string")).alias("x")), "quality-rows")
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").where(crc_mod("doc_id", folds) != held_out)
    model = fit(marked.select("doc_id", "x"), known)

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))))

    return marked.where(scored("x") >= THRESHOLD).select("row.*")

"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are its byte 3- and 4-grams after lower-casing A-Z and
turning ASCII non-letters into spaces. Each hashes to a bucket; the mean of
the buckets' embeddings goes through a linear softmax. Both layers learn by
stochastic gradient descent in numpy, on a bounded sample of labelled rows:
the PER_LANGUAGE rows of each language with the smallest id hashes, as far as
their features take MOST_BYTES together, shared evenly by the languages. A
temperature fitted on a fifth of the sample calibrates the probabilities, and
REJECTED of that fifth lies under the rejection limit.

Defined cases: null text, and text without a letter, is `und` with score 0;
with no labelled rows every text is; texts too short for a subword get the
prior; very long texts are predicted whole, a block at a time, and teach by
the shares of at most BUCKETS buckets; `rejected` marks scores under the limit
and every `und`; repeated rows and ties are scored alike, and an id that
repeats teaches once; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import blocks, bounded_batches, crc_mod, text_frame
from tessera.session import keep

BUCKETS = 1 << 14
WIDTH = 16
PER_LANGUAGE = 800
#: Rows of the whole sample, shared evenly where there are many languages.
MOST_ROWS = 40_000
#: Bytes of features that the driver gathers.
MOST_BYTES = 256 << 20
#: Up to so many languages, their counts and the sample's ids are sent to every task; with more they are joined by shuffling.
MANY_LANGUAGES = 500
EPOCHS, RATE, BATCH = 12, 4.0, 32
REJECTED = 0.01
_code = np.arange(256)
_letter = (((_code | 32) >= 97) & ((_code | 32) <= 122) & (_code < 128)) | (_code >= 128)
FOLD = np.where(_letter, np.where((_code >= 65) & (_code <= 90), _code + 32, _code), 32).astype(np.uint8)
_ANY_LETTER = regex.compile(r"\p{L}")


def subwords(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: the bucket at each position, and which positions lie within one text."""
    folded = FOLD[data].astype(np.uint32)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(data))
    code = folded.copy()
    for n in (2, 3, 4):
        code = (code[:-1] << np.uint32(8)) | folded[n - 1 :] if len(code) > 1 else code[:0]
        if n > 2:
            yield (code * np.uint32(2654435761) + np.uint32(n * 97)) >> np.uint32(18), left[: len(code)] >= n


def text_features(data: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket numbers and shares of each text."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    keys = np.concatenate([owner[: len(b)][ok] * BUCKETS + b[ok] for b, ok in subwords(data, at)] or [np.zeros(0, np.int64)])
    found, count = np.unique(keys, return_counts=True)
    cut = np.searchsorted(found, np.arange(n + 1) * BUCKETS)
    return [((found[a:b] % BUCKETS).astype(np.int32), (count[a:b] / max(1, count[a:b].sum())).astype(np.float32)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Softmax:
    """Embeddings, output layer, temperature and rejection limit."""

    def __init__(self, samples: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7):
        self.languages = sorted({s[0] for s in samples})
        index = {x: i for i, x in enumerate(self.languages)}
        k, rng = len(self.languages), np.random.default_rng(seed)
        order = rng.permutation(len(samples))
        tuned, taught = order[: len(order) // 5], order[len(order) // 5 :]
        labels = np.array([index[s[0]] for s in samples])
        embed = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
        out, bias = rng.normal(0, 0.1, (WIDTH, k)).astype(np.float32), np.zeros(k, np.float32)
        for epoch in range(EPOCHS if k > 1 else 0):
            rate = RATE * (1 - epoch / EPOCHS)
            for chunk in np.array_split(rng.permutation(taught), max(1, len(taught) // BATCH)):
                rows = np.concatenate([np.full(len(samples[i][1]), r) for r, i in enumerate(chunk)])
                cols, share = np.concatenate([samples[i][1] for i in chunk]), np.concatenate([samples[i][2] for i in chunk])
                x = np.zeros((len(chunk), BUCKETS), np.float32)
                x[rows, cols] = share
                hidden = x @ embed
                logit = hidden @ out + bias
                p = np.exp(logit - logit.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(chunk)), labels[chunk]] -= 1
                p /= len(chunk)
                used = np.unique(cols)
                back = x[:, used].T @ (p @ out.T)
                out -= rate * (hidden.T @ p)
                bias -= 0.1 * rate * p.sum(0)
                embed[used] -= rate * back * 16
        self.table, self.bias = (embed @ out).astype(np.float32), bias
        held = np.array([samples[i][2] @ self.table[samples[i][1]] + bias for i in tuned]) if len(tuned) else np.zeros((0, k))
        self.scale = 1.0
        if len(held):
            grid = np.geomspace(0.05, 50, 60)
            loss = [np.mean(np.log(np.exp(s * (held - held.max(1, keepdims=True))).sum(1)) - s * (held[np.arange(len(held)), labels[tuned]] - held.max(1))) for s in grid]
            self.scale = float(grid[int(np.argmin(loss))])
        self.limit = float(np.quantile(self.probabilities(held).max(1), REJECTED)) if len(held) else 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        p = np.exp(self.scale * (logits - logits.max(1, keepdims=True)))
        return p / p.sum(1, keepdims=True)

    def predict(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        total, grams = np.zeros((n, len(self.languages))), np.zeros(n)
        for bucket, ok in subwords(data, at):
            if not len(bucket):
                continue
            inside = np.minimum(at, len(bucket))
            counted = np.concatenate([[0], np.cumsum(ok)])
            grams += counted[inside[1:]] - counted[inside[:-1]]
            for c in range(len(self.languages)):
                summed = np.concatenate([[0.0], np.cumsum(np.where(ok, self.table[:, c][bucket], 0), dtype=np.float64)])
                total[:, c] += summed[inside[1:]] - summed[inside[:-1]]
        return self.probabilities(total / np.maximum(grams, 1)[:, None] + self.bias)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Softmax | None:
    """From (doc_id, text, lang); sees at most per_language rows of each language, and MOST_ROWS up to MANY_LANGUAGES of them."""
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / float(1 << 32)
    ranked = Window.partitionBy("lang").orderBy(share, "doc_id")
    ids = docs.where("lang is not null").select("doc_id", "lang")
    # by hash, about four times the rows wanted of each language come near the ranking, however many it has
    counts = ids.groupBy("lang").agg(F.count("*").alias("n"))
    languages = len(counts.select("n").limit(MANY_LANGUAGES + 1).collect())
    few = languages <= MANY_LANGUAGES
    per_language = max(1, min(per_language, MOST_ROWS // max(1, languages)))
    near = ids.join(F.broadcast(counts) if few else counts, "lang").where(share < 4.0 * per_language / F.col("n"))
    chosen = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= per_language).select("doc_id", "lang").distinct()
    # at most MOST_ROWS ids where there are few languages, so these can be sent to every task
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen) if few else chosen, ["doc_id", "lang"], "left_semi")
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")  # one row of an id that repeats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in blocks(batches):
            found = text_features(data, at)
            yield pa.RecordBatch.from_arrays([part.column(2), pa.array([f[0].tobytes() for f in found]), pa.array([f[1].tobytes() for f in found])], ["lang", "bucket", "share"])

    made = keep(texts.mapInArrow(run, "lang string, bucket binary, share binary"), "language-sample")
    so_far = Window.partitionBy("lang").orderBy(F.xxhash64("bucket", "share"), "bucket", "share").rowsBetween(Window.unboundedPreceding, 0)
    held = F.sum(F.octet_length("bucket") + F.octet_length("share")).over(so_far)
    rows = made.withColumn("held", held).where(F.col("held") <= MOST_BYTES // max(1, languages)).drop("held").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["bucket"], r["share"]))
    samples = [(r["lang"], np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["share"], np.float32)) for r in rows]
    return Softmax(samples) if samples else None


def identify(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of (doc_id, text, lang)."""
    bounded_batches(docs.sparkSession)
    rows = text_frame(docs, lang=docs["lang"].cast("string"))
    model = train(rows.where(crc_mod("doc_id", folds) != held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in blocks(batches):
            lettered = np.array([bool(x is not None and _ANY_LETTER.search(x)) for x in part.column(1).to_pylist()], bool)
            known = lettered & (model is not None)
            p = model.predict(data, at) if model is not None else np.zeros((part.num_rows, 1))
            best = p.argmax(1)
            names = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            score = np.where(known, p[np.arange(len(p)), best], 0.0)
            limit = model.limit if model is not None else 0.0
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(score), pa.array(~known | (score < limit))], ["doc_id", "lang_pred", "score", "rejected"])

    scored = rows.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
    return scored.select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score", "rejected")

"""The classifiers' queries recomputed by plain Python and held to held-out accuracy."""

from __future__ import annotations

import math
import zlib

import numpy as np

SF = "/root/testdata/sf0.01"


def test_language_query_by_hand(spark):
    from tessera.llm import blocks, language, queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = language.train(blocks.text_frame(docs, lang=docs["lang"]).where(blocks.crc_mod("doc_id", 3) != 1))
    got = queries.op4_language_id(spark, SF).collect()
    assert len(got) == len(rows)
    right = held = 0
    for r in got:
        text, lang = rows[r.doc_id].text, rows[r.doc_id].lang
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.held_out and lang is not None and r.lang_pred != "und":
            held += 1
            right += r.lang_pred == lang
        if r.doc_id % 7 or not any(c.isalpha() for c in text or ""):
            continue
        folded = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if b >= 128 or 97 <= b <= 122 else " " for b in text.encode())
        total, grams = np.zeros(len(model.languages)), 0
        for n in (3, 4):
            for i in range(len(folded) - n + 1):
                code = 0
                for c in folded[i : i + n]:
                    code = (code << 8 | ord(c)) & 0xFFFFFFFF
                total += model.table[((code * 2654435761 + n * 97) & 0xFFFFFFFF) >> 18]
                grams += 1
        logits = model.scale * (total / max(grams, 1) + model.bias)
        shares = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert r.lang_pred == model.languages[int(shares.argmax())] and math.isclose(r.score, shares.max(), rel_tol=1e-4)
    assert held > 100 and right >= 0.95 * held


def test_quality_query_by_hand(spark):
    from tessera.llm import quality, queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in docs]
    data = {i: quality.statistics(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for i, t in docs.items()}
    for i, text in list(docs.items())[:200]:  # some statistics, counted plainly
        words = [w for w in (text or "").encode().split() if w]
        assert math.isclose(data[i][0], math.log1p(len(words)))
        size = [len(w) for w in words]
        assert math.isclose(data[i][7], math.log1p(sum(size) / max(1, len(size))), rel_tol=1e-9)
        assert math.isclose(data[i][10], math.log1p(len(set(words))) / math.log1p(max(1, len(words))), rel_tol=1e-9)
        assert math.isclose(data[i][9], math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / (len(words) + 10)), rel_tol=1e-9)
    taught = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 != 0 and q in (0, 1)]
    x = np.array([data[i] for i, _ in taught])
    y = np.array([q for _, q in taught])
    spread = np.where(x.std(0) > 1e-9, x.std(0), 1)
    z = (x - x.mean(0)) / spread
    own = [np.cov(z[y == c], rowvar=False, bias=True) for c in (0, 1)]
    both = sum((y == c).mean() * own[c] for c in (0, 1))
    cov = [(1 - quality.POOLED - quality.DIAGONAL) * own[c] + quality.POOLED * both + quality.DIAGONAL * np.diag(np.maximum(np.diag(both), 1e-3)) + 1e-3 * np.eye(len(both)) for c in (0, 1)]
    truth, right, held = dict(labels), 0, 0
    for r in queries.op8_quality_classifier(spark, SF).collect():
        own_z = np.clip((data[r.doc_id] - x.mean(0)) / spread, -12, 12)
        logs = [-0.5 * (own_z - z[y == c].mean(0)) @ np.linalg.solve(cov[c], own_z - z[y == c].mean(0)) - 0.5 * np.linalg.slogdet(cov[c])[1] + math.log((y == c).mean()) for c in (0, 1)]
        score = 1 / (1 + math.exp(-max(-500, min(500, logs[1] - logs[0]))))
        assert math.isclose(r.score, score, rel_tol=1e-5, abs_tol=1e-9) and r.predicted == (r.score >= 0.3)
        if r.held_out and r.doc_id in truth:
            held += 1
            right += r.predicted == truth[r.doc_id]
    assert held > 20 and right >= 0.9 * held

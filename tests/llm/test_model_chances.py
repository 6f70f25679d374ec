"""F1: scores of bytes never seen after a context that was met tens of millions of times."""

from __future__ import annotations

import numpy as np


def test_a_byte_never_seen_after_a_very_frequent_context_has_a_chance():
    from tessera.llm import contexts

    n = 1 << 28
    code = lambda text: np.uint64(int.from_bytes(text.encode(), "big"))
    key = np.array([code("aaaaag"), code("aaaaao")], np.uint64)
    tables, _ = contexts.subtree(key[1:], np.array([n]), 0)
    have, count = tables[contexts.DEPTH]
    tables[contexts.DEPTH] = (have, np.concatenate([[0], np.cumsum(count)]))
    rare, frequent = contexts.log10_of(key, tables)
    assert np.isfinite(rare) and np.isclose(rare, np.log10(0.5 / (n + 1)) - 3 * np.log10(2), atol=0.3)
    assert -1e-6 < frequent <= 0


def test_chances_keep_both_sides():
    from tessera.llm import contexts

    chance = np.array([0.25, 0.5, 0.75, 1 - 1e-9])
    assert np.allclose(contexts.signed(chance), [0.25, 0.5, -0.25, -1e-9], rtol=1e-6)

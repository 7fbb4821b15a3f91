"""Toxicity of words longer than a piece."""

from __future__ import annotations

import numpy as np
import pytest
from llm.test_scans import toxic_docs

from torqueline.llm import toxicity


@pytest.mark.parametrize("word", ["a" * 64, "a" * 65, "漢字" * 200, "ab_" * 500, "\U0001f600é漢a" * 90, "\ud800" * 80, "x" * 10_000])
def test_pieces_cover_the_word(word):
    pieces = toxicity.pieces_of(word)
    at = 0
    for n, p in enumerate(pieces):
        assert 0 < len(p.encode("utf-8", "surrogatepass")) <= toxicity.PIECE
        start = word.index(p, max(0, at - toxicity.OVERLAP - 4)) if n else 0
        assert start <= at
        at = max(at, start + len(p))
    joined = {word.encode("utf-8", "surrogatepass")[i:i + 5] for i in range(len(word.encode("utf-8", "surrogatepass")) - 4)}
    assert joined <= {b[i:i + 5] for b in (p.encode("utf-8", "surrogatepass") for p in pieces) for i in range(len(b))}
    assert (len(pieces) == 1) == (len(word.encode("utf-8", "surrogatepass")) <= toxicity.PIECE)


def test_a_toxic_word_behind_a_hundred_letters():
    rows = toxic_docs(400, 4)
    net = toxicity.train([r[1] for r in rows], np.array([r[2] for r in rows]))
    harmless = next(r[1] for r in rows if not r[2])
    for head in ("e" * 100, "漢" * 100, "_".join(harmless.split())):
        clean, toxic = net.scores([f"{harmless} {head}", f"{harmless} {head}zwuckaa"])
        assert toxic > clean + 0.2

"""Repeated passages of fifty words with one full stop or none."""

from __future__ import annotations

import random

import pytest
from llm.test_scans import removed_by_hand

from torqueline.llm import substrings


def prose(rng, n, stop=0, comma=0):
    w = [rng.choice(["lo", "ra", "mi", "tes"]) + str(rng.randint(0, 9999)) for _ in range(n)]
    return " ".join(x + ("." if stop and k % stop == stop - 1 else "," if comma and k % comma == comma - 1 else "") for k, x in enumerate(w))


@pytest.mark.parametrize(("stop", "comma"), [(0, 0), (0, 6), (30, 0), (25, 7), (20, 0), (17, 5), (13, 9), (9, 0)])
def test_fifty_shared_words_hold_a_span(stop, comma):
    rng = random.Random(stop * 100 + comma)
    for _ in range(150):
        passage = " ".join(prose(rng, 80, stop, comma).split()[(o := rng.randint(0, 29)):o + 50])
        hashes = []
        for _ in range(2):
            around = [prose(rng, rng.randint(0, 60), rng.choice([0, 8, 30]), rng.choice([0, 5])) for _ in range(2)]
            text = f"{around[0]} {passage} {around[1]}".strip()
            hashes.append({h for _, _, h in substrings.spans_of(text, 3, 15)})
            assert "".join(substrings.sentences(text)) == text
        assert hashes[0] & hashes[1], passage


@pytest.mark.parametrize("stop", [0, 30])
def test_passages_without_sentences_are_removed(spark, stop):
    rng = random.Random(13)
    passage = prose(rng, 70, stop)
    docs = [(i, f"{prose(rng, 40 + i)} {passage} {prose(rng, 30)}") for i in range(4)] + [(8, "la " * 400), (9, prose(rng, 200))]
    got = sorted(map(tuple, substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == sorted(removed_by_hand(docs, 3, 15))
    texts = {r[0]: r[1] for r in got}
    words = passage.split()
    assert texts[0] == docs[0][1] and texts[9] == docs[5][1]
    for i in range(1, 4):
        assert sum(w in texts[i].split() for w in words) < 40 and set(docs[i][1].split()) - set(words) <= set(texts[i].split())
    assert len(texts[8].split()) < 50

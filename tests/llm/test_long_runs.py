"""Personal data in runs of many digit groups and behind long local parts."""

from __future__ import annotations

import random

import pytest
from llm.test_scans import contact

from torqueline.llm import pii

RUN = "+33 1 23 45 67 89 4111 1111 1111 1111"


def grouped(rng):
    """A phone of six groups or a card of four, eight or sixteen."""
    if rng.random() < 0.5:
        return f"+33 {rng.randint(1, 9)} " + " ".join(f"{rng.randint(0, 99):02}" for _ in range(4))
    card = "".join(str(rng.randint(0, 9)) for _ in range(15))
    card += next(str(d) for d in range(10) if pii.luhn(card + str(d)))
    size = rng.choice([4, 2, 1])
    return " ".join(card[i:i + size] for i in range(0, 16, size))


@pytest.mark.parametrize(("text", "kind", "part"), [
    (RUN, 3, "+33 1 23 45 67 89"), (RUN, 2, "4111 1111 1111 1111"),
    ("+33 1 23 45 67 89 41 11 11 11 11 11 11 11", 2, "41 11 11 11 11 11 11 11"),
    ("+33 1 23 45 67 89 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", 2, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"),
    (f"x {'a' * 100}@host", 0, f"{'a' * 100}@host"), (f"x {'a' * 20_000}@host", 0, f"{'a' * 20_000}@host"),
])
def test_long_spans_are_proposed(text, kind, part):
    at = text.index(part)
    assert (kind, at, at + len(part)) in pii.candidates(text)


def test_candidates_stay_linear():
    assert len(pii.candidates("1 " * 20_000)) < 20_000 * 20
    assert len(pii.candidates("a@" * 20_000)) < 20_000 and pii.candidates("a" * 100_000 + "@") == []


def test_trees_part_a_phone_and_a_card_of_many_groups(spark):
    rng = random.Random(12)
    docs = [(i, " ".join(rng.choice(["call", "the", "of", rng.choice([contact, grouped])(rng) + " now"]) for _ in range(30))) for i in range(600)]
    detector = pii.fit_detector(spark.createDataFrame(docs, "doc_id long, text string"))
    text = f"see {RUN} today"
    assert pii.redact_text(text, detector.spans(text)) == "see [PHONE] [CARD] today"

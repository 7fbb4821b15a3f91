"""The detector learns from every candidate of every document."""

from __future__ import annotations

import random

import numpy as np
from llm.test_scans import contact
from pyspark.sql import functions as F

from torqueline.llm import boosting, pii


def by_hand(spark, texts):
    """Features, labels and held-out marks of all candidates, counted one by one."""
    held = {r.t: r.h for r in spark.createDataFrame([(t,) for t in set(texts)], "t string").select("t", ((F.xxhash64("t").bitwiseAND(F.lit(3))) == 0).alias("h")).collect()}
    rows = [(x, y, held[t]) for t in texts for x, y in pii.training_rows(t)]
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])


def test_fit_reads_every_candidate(spark):
    rng = random.Random(21)
    pool = [f"{rng.choice(['call', 'the', 'of'])} {contact(rng)} now {contact(rng)}" for _ in range(400)]
    texts = [pool[int(len(pool) * rng.random() ** 2)] for _ in range(30_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    x, y, held = by_hand(spark, texts)
    assert len(y) > 50_000
    counts = pii.training_counts(docs)
    assert counts.agg(F.sum("n")).first()[0] == len(y)
    got = pii.fit_detector(docs)
    share = y[~held].mean()
    assert abs(got.trees.prior - np.log(share / (1 - share))) < 1e-12
    # the same trees as from all rows in memory, and the thresholds of all held-out rows
    whole = boosting.fit_boosted(x[~held], y[~held])
    assert np.array_equal(got.trees.feature[0], whole.feature[0]) and np.array_equal(got.trees.cut[0], whole.cut[0])
    score = got.trees.predict(x)
    assert np.abs(score - whole.predict(x)).max() < 0.01
    for k in range(4):
        mine = held & (x[:, k] == 1)
        chosen, expected = (score[mine] >= t for t in (got.least[k], boosting.threshold_for(score[mine], y[mine], 0.95)))
        assert np.array_equal(chosen, expected)
    again = pii.fit_detector(docs.repartition(7))
    assert again.least == got.least and all(np.array_equal(getattr(again.trees, c), getattr(got.trees, c)) for c in ("feature", "cut", "leaf"))


def test_tables_give_the_trees_of_arrays(spark, monkeypatch):
    """Sums added in a shuffle, weighted rows, values behind the last cut."""
    monkeypatch.setattr(boosting, "DRIVER_CELLS", 0)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(800, 3)) * 8).astype(np.float32)
    y = (x[:, 0] + rng.normal(size=800) * 3 > x[:, 1]).astype(np.int32)
    n = rng.integers(1, 4, 800)
    rows = spark.createDataFrame([(bytes(a.tobytes()), int(b), int(c)) for a, b, c in zip(x, y, n, strict=True)], "x binary, y int, n long")
    cuts = boosting.value_cuts(rows, 3, 32)
    full, ones = np.repeat(x.astype(float), n, axis=0), np.repeat(y, n)
    for f in range(3):
        assert np.array_equal(cuts[f], np.unique(np.quantile(full[:, f], np.linspace(0, 1, 32), method="lower")))
    binned = boosting.binned_rows(rows, cuts)
    trees = boosting.fit_boosted_rows(binned, cuts, int((ones == 0).sum()), int(ones.sum()), rounds=6)
    whole = boosting.fit_boosted(full, ones.astype(float), rounds=6)
    got = boosting.valued(trees, cuts)
    assert np.array_equal(got.feature, whole.feature) and np.array_equal(got.cut, whole.cut)
    assert np.abs(got.leaf - whole.leaf).max() < 1e-5
    assert np.abs(got.predict(np.full((1, 3), 1e6)) - whole.predict(np.full((1, 3), 1e6))).max() < 1e-5

"""Language model: exact base scores, filter against exact counts, held-out gain, blocks, odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from llm.conftest import EDGE

from torqueline.llm import language_model as lm
from torqueline.llm import wordbytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def base_by_hand(docs):
    held = [crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in docs]
    counts = Counter(t for (_, text), h in zip(docs, held) if not h for t in tokens(text))
    n, v = counts.total(), len(counts)
    return sorted((str(d), h, len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 5))
                  for (d, text), h in zip(docs, held) for t in [tokens(text)])


def told(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in df.collect())


@pytest.mark.parametrize("often", [1e-5, 0.05, 2.0])
def test_base_score_equals_brute_force(spark, edge, often):
    assert told(lm.score_documents(edge, often=often)) == base_by_hand([(r[0], r[1]) for r in EDGE])


def test_empty_table_and_no_training_rows(spark, empty):
    assert lm.score_documents(empty).count() == 0
    ids = [i for i in range(200) if crc32(str(i).encode()) % 10 == 0][:3]
    only = spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")
    rows = lm.score_documents(only).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in rows} == {(3, 0, 0)}
    assert all(math.isfinite(r.score) and r.base_score == pytest.approx(0.0) for r in rows)


def test_words_are_hashed_alike_wherever_a_stretch_ends(monkeypatch):
    text = "Some Words ünd mehr\twith  gaps\nand verylongwordswithoutanyend x ".encode() * 9
    whole, _, ends = wordbytes.words_of(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(wordbytes, "STRETCH", 13)
    cut, _, cut_ends = wordbytes.words_of(np.frombuffer(text, np.uint8))
    assert (whole == cut).all() and (ends == cut_ends).all() and len(whole) == len(text.split())
    assert len(set(whole.tolist())) == len(set(text.lower().split()))


def test_filter_gives_levels_back():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = rng.zipf(1.5, len(hashes)).clip(1, 1 << 20)
    data = lm.built(hashes, counts, 10.0, 4)
    held = lm.Filter(0, np.array([len(data)]), 1, 4)
    held.put(0, data)
    got, want = held.levels(hashes).astype(int), lm.levels_of(counts)
    assert (got >= want).all() and (got > want).mean() < 0.03  # one-sided error
    assert (held.levels(rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)) > 0).mean() < 0.03


@pytest.mark.parametrize("order", [2, 3])
def test_scores_follow_exact_counts(spark, order):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 60)))) for i in range(300)]
    got = {r.doc_id: r.score for r in lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), order=order, bits_each=40.0).collect()}
    grams = Counter()
    for d, text in docs:
        if crc32(str(d).encode()) % 10:
            t = ["<", *tokens(text)]
            for n in range(1, order + 1):
                grams.update(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
    n = sum(c for g, c in grams.items() if len(g) == 1 and g != ("<",))
    v = sum(1 for g in grams if len(g) == 1 and g != ("<",))

    def count(g):
        level = grams[g].bit_length()
        return (2 ** (level - 1) + 2 ** level - 1) / 2 if level else 0

    for d, text in docs:
        t, total = ["<", *tokens(text)], 0.0
        for i in range(1, len(t)):
            before = {1: count((t[i],))}
            p = (min(before[1], n) + 0.1) / (n + 0.1 * (v + 1))
            for k in range(2, order + 1):
                if i - k + 1 >= 0:
                    def capped(g):
                        c = count(g)
                        return min(c, capped(g[1:]), capped(g[:-1])) if len(g) > 1 else c
                    h = tuple(t[i - k + 1:i])
                    both = capped((*h, t[i]))
                    p = (both + 5.0 * p) / (capped(h) + 5.0)
            total += math.log10(p)
        assert got[d] == pytest.approx(total, abs=1e-6)


def test_blocks_do_not_change_scores(spark, edge):
    one = sorted((str(r.doc_id), r.score) for r in lm.score_documents(edge).collect())
    lm_blocks = sorted((str(r.doc_id), r.score) for r in lm.score_documents(edge, block_bytes=1).collect())
    assert one == lm_blocks


def test_many_segments_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, " ".join(rng.choice(list("abcdefgh"), 40))) for i in range(100)], "doc_id long, text string").repartition(3)
    parts, n = lm.fitted(df.select("text"), "text", 40 * lm.PER_SEGMENT, 2, 10.0, 4)
    assert n == 80 and len(lm.list_of_blocks(parts, n, 40)) > 5
    one = sorted((r.doc_id, r.score) for r in lm.score_documents(df, bits_each=40.0).collect())
    monkeypatch.setattr(lm, "PER_SEGMENT", 100)
    assert len(one) == 100
    several = sorted((r.doc_id, r.score) for r in lm.score_documents(df, block_bytes=60, bits_each=40.0).collect())
    assert np.allclose([s for _, s in one], [s for _, s in several], rtol=1e-9)


def test_held_out_texts_gain_from_the_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm.score_documents(docs).collect() if r.held_out]
    assert len(rows) > 50 and sum(r.score for r in rows) > 0.98 * sum(r.base_score for r in rows)


def test_wide_rows_of_packs_lie_in_small_row_groups(spark):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(0)
    texts = [(i, " ".join(rng.bytes(6).hex() for _ in range(200_000)), False) for i in range(9)]
    d = spark.createDataFrame(texts, "id long, text string, held boolean").coalesce(1)
    packs = lm.settle(lm._bundled(lm.with_text_batches(d), "bigint"), "packs", options=lm.WIDE_ROWS)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata.row_group(g) for f in map(str, packs.inputFiles())
              for g in range(pq.ParquetFile(f.removeprefix("file:")).metadata.num_row_groups)]
    assert packs.count() > 3 and max(g.num_rows for g in groups) <= 3 and len(groups) > 1
    assert sorted(r[0] for r in packs.selectExpr("explode(ids)").collect()) == list(range(9))

"""Language model: rare words go packed, whole and exact, from texts to the vocabulary and back."""

from __future__ import annotations

import re
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from llm.test_language_model import base_by_hand, told

from torqueline.llm import language_model as lm
from torqueline.llm import wordbytes


def test_rare_words_are_not_rows(spark, edge):
    plan = lm.score_documents(edge, often=2.0)._jdf.queryExecution().toString()
    assert not re.search(r"\bGenerate\b|explode", plan) and "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("often", [0.02, 2.0])
@pytest.mark.parametrize("size", [1, 40])
def test_many_packs_and_buckets(spark, monkeypatch, often, size):
    monkeypatch.setattr(lm, "RARE_PACK", size)
    monkeypatch.setattr(lm, "PER_SEGMENT", 5)
    monkeypatch.setattr(wordbytes, "SLICE", 64)  # several slices, and so packs, in a batch
    rng = np.random.default_rng(7)
    docs = [(i, " ".join(f"W{x}" for x in rng.zipf(1.3, rng.integers(0, 40)))) for i in range(60)]
    docs += [(-1, None), (None, "x" * 65 + " " + "X" * 65), (-1, "w1 \0w1")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert told(lm.score_documents(df, often=often)) == base_by_hand(docs)


def test_a_text_of_millions_of_one_word(spark):
    docs = [(1, "a " * 2_000_000), (2, "a b"), (20, "b c")]
    assert told(lm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"))) == base_by_hand(docs)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lm, "hashes_of", lambda names: np.zeros(len(names), np.uint64))
    found, units = lm.Frequent([b"a", b"b"], [10, 1000]).of(pa.array([b"c", b"b", b"a", b""], pa.binary()))
    right = {1: 1000, 2: 10}
    assert found.sum() == 1 and all(units[i] == lm.units_of(np.array([right[i]]))[0] for i in np.flatnonzero(found))


@pytest.mark.parametrize("run", [1, 13, 1 << 16])
def test_distinct_words_have_the_hashes_of_the_words(monkeypatch, run):
    monkeypatch.setattr(wordbytes, "RUN", run)
    data = np.frombuffer("\tSome Words ünd some\x0bWORDS \x1c \0 verylongwordswithoutanyend\n".encode() * 9 + b"x", np.uint8)
    want, _, ends = wordbytes.words_of(data)
    words, which, last = wordbytes.distinct_words(data)
    assert (wordbytes.hashes_of(words)[which] == want).all() and (last == ends).all()
    assert [words[i].as_py() for i in which] == data.tobytes().lower().split()
    assert len(set(words.to_pylist())) == len(words)
    assert (wordbytes.hashes_of(words.slice(2)) == wordbytes.hashes_of(words)[2:]).all()


def test_no_words():
    words, which, last = wordbytes.distinct_words(np.frombuffer(b" \n", np.uint8))
    assert len(words) == len(which) == len(last) == len(wordbytes.hashes_of(words)) == 0


def test_a_large_filter_is_not_read_block_by_block(spark, edge, monkeypatch):
    def scores(**block):
        return sorted((str(r.doc_id), r.n_known, r.base_score, r.score) for r in lm.score_documents(edge, **block).collect())

    monkeypatch.setattr(lm, "PER_SEGMENT", 5)
    monkeypatch.setattr(lm, "BUNDLE", 50)  # several packs in a batch
    one = scores()
    written, settle = [], lm.settle

    def noted(df, name="stage", path=None):
        out = settle(df, name, path)
        written.append((name, out.inputFiles()))
        return out

    monkeypatch.setattr(lm, "settle", noted)
    assert scores(block_bytes=1) == one
    assert [name for name, _ in written] == ["vocabulary", "filter", "packs", "answers", "scored"]
    left = {name for name, files in written if any(Path(urlparse(f).path).exists() for f in files)}
    assert left == {"vocabulary", "filter", "scored"}


@pytest.mark.parametrize("kind", ["string", "int", "date"])
def test_rows_of_any_id_in_packs(spark, monkeypatch, kind):
    monkeypatch.setattr(lm, "PER_SEGMENT", 5)
    monkeypatch.setattr(lm, "BUNDLE", 64)
    docs = [(None, "a b"), (None, "a b"), *[(i, "a b c " * i) for i in range(40)], (3, None), (50, "x" * 200 + " a")]
    of = {"string": "cast(i as string)", "int": "cast(i as int)", "date": "date_add(date'2020-01-01', cast(i as int))"}[kind]
    df = spark.createDataFrame(docs, "i long, text string").selectExpr(f"{of} as doc_id", "text").repartition(3)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    def scores(df):
        return sorted((str(r.doc_id), r.n_tokens, r.score) for r in df.collect())

    got = lm.score_documents(df, block_bytes=1)
    assert dict(got.dtypes)["doc_id"] == kind and told(got) == base_by_hand(rows)
    assert scores(got) == scores(lm.score_documents(df))

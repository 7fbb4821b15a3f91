"""Every stage of the pipeline against a brute-force version of it, and the registered queries against their twins."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pytest
from llm.test_native import hits_of
from llm.test_scans import base_by_regex
from llm.test_similar import kept_by_hand
from oracle import compare, connect

import corpus_pipeline
from torqueline.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def results(spark):
    """Rows of documents and of every stage, by doc_id; each stage reads what the one before wrote."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": {r.doc_id: r for r in docs.collect()}}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.settle(stage(spark, docs, SF), name)
        assert n == len(corpus_pipeline.STAGES) - 1 or docs.columns == COLUMNS
        out[name] = {r.doc_id: r for r in docs.collect()}
    return out


def passes(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    grams = [tuple(w[i:i + 5]) for i in range(n - 4)]
    seen, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars = sum(map(len, w))
    return not (
        n < 10 or 100 * len(cover) > 20 * n or sum(text.count(c) for c in "#*$%&|<>") > 0.1 * n
        or len(lines) - len(set(lines)) > 0.5 * len(lines) or not 2 * n <= chars <= 15 * n
        or sum(a == b for a, b in zip(w, w[1:], strict=False)) > 0.3 * n or text.count("!") > 0.4 * n)


def test_quality_stage(results):
    assert results["quality_rules"] == {k: r for k, r in results["documents"].items() if passes(r.text or "")}


def test_near_dedup_stage(results):
    docs = sorted(results["quality_rules"].items())
    kept = set(kept_by_hand([(k, r.text) for k, r in docs]))
    assert results["near_dedup"] == {k: r for k, r in docs if k in kept}


def test_decontamination_stage(spark, results):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert results["decontaminated"] == {k: r for k, r in results["near_dedup"].items() if not hits_of(r.text, items)[1]}


def test_redaction_stage(results):
    assert set(results["redacted"]) == set(results["decontaminated"])
    changed = 0
    for k, r in results["decontaminated"].items():
        new = results["redacted"][k]
        base = base_by_regex(r.text)
        assert new.n_chars == len(new.text) and base_by_regex(new.text) == [] and new.source == r.source
        # between the base spans the text stays, but for spans that the trees add, which hold digits or an @
        parts, free = [], 0
        for _, a, b in base:
            parts.append(r.text[free:max(a, free)])
            free = max(free, b)
        kept = [w for part in [*parts, r.text[free:]] for w in re.split(r"\S*[0-9@]\S*", part)]
        at = 0
        for part in kept:
            assert (at := new.text.find(part.strip(), at)) >= 0
        changed += bool(base)
        if not re.search(r"[0-9@]", r.text):
            assert new.text == r.text
    assert changed > 3


def test_mixing_stage(results):
    by = {}
    for r in results["mix_sources"].values():
        assert r["size"] == len(results["redacted"][r.doc_id].text.split()) and r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    total = sum(r["size"] for own in by.values() for r in own)
    assert abs(sum(own[0].target for own in by.values()) - 1.5 * total) < 1e-6 * total
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)


def test_run_is_the_chain_of_stages(spark, results):
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {k: r.taken for k, r in results["mix_sources"].items()}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_equals_twin(spark, duck, name):
    fn, sql = REGISTRY[name]
    assert compare(fn(spark, SF), duck, sql) is None


@pytest.mark.parametrize("name", ["op2_warc_derivatives", "op5_substring_dedup", "op7_secret_scan", "op10_personal_data"])
def test_queries_run_over_whole_tables(spark, name):
    table = "pages" if name.startswith("op2") else "documents"
    rows = REGISTRY[name][0](spark, SF).count()
    assert rows == spark.read.parquet(f"{SF}/{table}.parquet").count() * (2 if table == "pages" else 1)

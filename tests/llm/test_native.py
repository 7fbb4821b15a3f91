"""Decontamination, license scan, quality rules and mixing: odd cases and brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from conftest import plan_of
from llm.conftest import EDGE, sorted_rows
from pyspark.sql import functions as F

from torqueline.llm import decontaminate, grams, licenses, mixing, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def hits_of(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        size = min(window, len(iw))
        for s in range(len(iw) - size + 1 if size else 0):
            for at in range(len(w) - size + 1):
                if w[at:at + size] == iw[s:s + size]:
                    hit.update(range(at, at + size))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def random_texts():
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 3, 4, 7, 12, 14])))) for i in range(8)]
    docs = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    docs += [(100 + i, f"x {t} y, {t.upper()}") for i, (_, t) in enumerate(items)]
    return docs, items + [(None, "a b c d a b c d a b c"), (50, None), (51, "..."), (0, items[0][1])]


@pytest.mark.parametrize("block_rows", [100_000, 7])
def test_contamination_equals_brute_force(spark, random_texts, block_rows):
    docs, items = random_texts
    got = decontaminate.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"),
        block_rows=block_rows)
    want = {(d, *map(str, hits_of(t, items))) for d, t in docs}
    assert {(r.doc_id, str(r.n_words), str(r.n_hit), str(r["items"])) for r in got.collect()} == want


def test_contamination_odd_cases(spark, edge, empty):
    items = spark.createDataFrame([("x", "three four five six seven eight nine ten eleven twelve"), ("y", None)], "item_id string, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(edge, items).collect()}
    assert got[1, 15].n_hit == 10 and got[1, 15]["items"] == ["x"] and got[2, 0].n_hit == 0
    assert decontaminate.contamination(edge, items).count() == len(EDGE)
    assert decontaminate.contamination(empty, items).count() == 0
    none = items.where("false")
    assert decontaminate.contamination(edge, none).where("n_hit > 0").count() == 0
    left = decontaminate.clean_documents(edge, items)
    assert left.columns == edge.columns and left.count() == len(EDGE) - 2


def test_contamination_keeps_texts_in_place(spark, edge):
    """Texts meet the items by broadcast; no exchange carries words."""
    at = grams.with_grams(grams.positions(edge, "doc_id", "text"), [5])
    plan = plan_of(at.join(F.broadcast(spark.range(3).withColumnRenamed("id", "gram")), "gram"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Python" not in plan


def test_licenses_odd_cases(edge, empty):
    got = licenses.scan_licenses(edge)
    assert got.count() == len(EDGE) and licenses.scan_licenses(empty).count() == 0
    rows = {(r.doc_id, r.n_words): r for r in got.collect()}
    r = rows[1, 15]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (1, 12, 12, "reserved", 1.0)
    assert rows[2, 0].labels == "" and rows[2, 0].first_word is None and rows[2, 0].score == 0
    assert "Python" not in plan_of(got)


def test_licenses_base_places(spark):
    rng = random.Random(3)
    vocabulary = "cc by general public license all rights reserved x".split()
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for d, text in docs:
        w = words(text)
        at = [(i, x) for p, x in licenses.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        want = (len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))
        assert (got[d].n_base, got[d].first_word, got[d].last_word, got[d].base_labels) == want


def test_licenses_shifted_notice(spark):
    apart = "Redistribution and use in source and (also) binary forms, with or without modification, are permitted"
    rows = licenses.scan_licenses(spark.createDataFrame(
        [(1, f"foo {apart} bar"), (2, "redistribution and use of binary forms")], "doc_id long, text string")).collect()
    got = {r.doc_id: (r.labels, r.score) for r in rows}
    assert got[1][0] == "bsd" and 0.8 <= got[1][1] < 1 and got[2] == ("", 0.0)


def test_quality_odd_cases(edge, empty):
    got = quality.judge_documents(edge)
    assert got.count() == len(EDGE) and quality.judge_documents(empty).count() == 0
    by = {(r.doc_id, r.n_words): r.rejected_by for r in got.collect()}
    assert by[1, 15] is None and by[2, 0] == "too_short" and by[4, 0] == "too_short" and by[5, 24000] is not None
    kept = quality.filter_documents(edge)
    assert kept.columns == edge.columns and sorted_rows(kept, "doc_id") == [(1,), (1,)]
    assert quality.filter_documents(empty).count() == 0 and "Python" not in plan_of(kept)


def test_cascade_order_changes_the_reason_only(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "ccc!", "#", "dddd\n"]) for _ in range(rng.randint(0, 40))) for _ in range(100)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    using = quality.rules()
    frames = [docs.select("text", quality.rejected_by(F.col("text"), o).isNull().alias("kept")) for o in (using, using[::-1])]
    assert sorted(map(tuple, frames[0].collect())) == sorted(map(tuple, frames[1].collect()))
    assert sorted(r.name for r in quality.plan_cascade(docs, using)) == sorted(r.name for r in using)


def test_repeat_words_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in range(60)] + ["a " * 500, " ".join(map(str, range(3000)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.judge_documents(docs).collect():
        w, cover = texts[r.doc_id].split(), set()
        g = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        for i, x in enumerate(g):
            if g.count(x) > 1 if len(g) < 600 else False:
                cover.update(range(i, i + 5))
        assert r.n_repeat_words == len(cover)


def test_mixing_takes_what_it_should(spark):
    rng = random.Random(4)
    docs = [(i, "w " * rng.randint(0, 50), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(800)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df, rows_per_range=20).collect()
    again = mixing.mix(df.repartition(5), rows_per_range=100_000).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 2 * r["size"] and (r.taken % r["size"] == 0 if r["size"] else r.taken == 0)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50
        assert own[0].target <= 2 * own[0].source_size
    assert abs(sum(own[0].target for own in by.values()) - 1.5 * total) < 1e-6
    weights = dict(zip(sorted(k for k in by if k) + [None], [3, 1, 2, 3], strict=True))
    free = {k: own[0].target / weights[k] for k, own in by.items() if own[0].target < 2 * own[0].source_size}
    assert max(free.values()) - min(free.values()) < 1e-6 * total


def test_mixing_odd_cases(edge, empty, spark):
    rows = mixing.mix(edge).collect()
    assert len(rows) == len(EDGE) and mixing.mix(empty).count() == 0
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


def test_better_documents_come_first(spark):
    """With a weight ten times as high, clean documents are drawn far more often than junk."""
    docs = [(i, "word " * 20 if i % 2 else "### " * 20, "a") for i in range(2000)] + [(9000 + i, "word " * 20, "b") for i in range(400)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), weights=(1, 3)).collect()
    extra = [sum(r.taken > r["size"] for r in rows if r.doc_id < 2000 and r.doc_id % 2 == k) for k in (0, 1)]
    assert extra[1] > 3 * extra[0] > 0


def test_item_list_hash_is_plain(spark):
    got = decontaminate.contamination(
        spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(10, "b"), (9, "a")], "item_id long, text string"))
    assert hashlib.sha256(",".join(got.first()["items"]).encode()).hexdigest() == hashlib.sha256(b"10,9").hexdigest()

"""Secrets, personal data, toxicity, WARC, substrings and SimHash: odd cases and brute force."""

from __future__ import annotations

import json
import random
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm.conftest import EDGE, sorted_rows

from torqueline.llm import automaton, boosting, pii, secrets, simhash, substrings, toxicity, warc


# secrets

@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner(secrets.BASE + secrets.PROVIDERS)


def spans_by_regex(text):
    out = []
    for n, r in enumerate(secrets.BASE + secrets.PROVIDERS):
        for m in re.finditer(r.pattern, text, (re.I | re.A) if r.ignore_case else 0):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), m.end(), n))
    return sorted(out)


def test_secret_spans_equal_regexes(scanner):
    rng = random.Random(1)
    parts = ["password", "passwd", "secret", "token", "api_key", "apikey", "TOKEN", "=", ":", " ", "'", '"', "a", "b", "f0", "AKIA",
             "9Z", "é", "\n", "xyz_", "-----BEGIN RSA PRIVATE KEY-----", "eyJab.", "ghp_", "deadbeefdeadbeefdeadbeef", "\U0001f600", "K"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["", None, "a" * 100_000, "deadbeef" * 20_000, "token=" * 5000]
    assert scanner.spans(pa.array(texts)) == [spans_by_regex(t or "") for t in texts]
    assert scanner.spans(pa.array(texts[:9])) == [spans_by_regex(t) for t in texts[:9]]  # too few lanes for lockstep
    assert scanner.spans(pa.array(texts).slice(10, 300)) == [spans_by_regex(t) for t in texts[10:310]]


@pytest.mark.parametrize("pattern", [
    "a(b|cd)*e?", r"[^a-c]+x{2,3}", r"(?:a|b){3}", "a{0,2}b", r"\x41\.", "[a-]+", "(ab|a)(bc|c)?", "(a?){2}b+", "[0-9a-f]{4,}",
])
def test_automaton_accepts_what_the_regex_does(pattern):
    rng = random.Random(7)
    a = automaton.compile_rules([(pattern, False)], search=False)
    for _ in range(3000):
        t = bytes(rng.choice(b"abcdex-A.0f") for _ in range(rng.randint(0, 9)))
        s = 0
        for b in t:
            s = a.step[s, b]
        assert bool(a.accepts[s]) == bool(re.fullmatch(pattern.encode(), t, re.S)), t


def test_automaton_is_minimal():
    assert len(automaton.compile_rules([("(ab|cb)", False)], search=False).step) == 4
    assert len(automaton.compile_rules([("aa|aa", True)], search=True).step) == 3


def test_secrets_odd_cases(edge, empty):
    got = secrets.find_secrets(edge)
    assert got.count() == len(EDGE) and secrets.find_secrets(empty).count() == 0
    assert [[tuple(s) for s in r.spans] for r in got.where("doc_id is null").collect() if r.spans] == [[("assign", 26, 41)]]


# personal data

def luhn_by_hand(digits):
    doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_by_regex(t):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
                r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn_by_hand(d), 10 <= len(d) <= 15)[k]
            out += [(k, *m.span())] if ok else []
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_equal_regexes():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@x", "1", "22", "300", ".", ".", "-", " ", "+", "(", ")", "+1 (555) 555-1234", "4111111111111111", "1.2.3.4", "é", " 12"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t)[0] == base_by_regex(t)
    assert pii.base_spans("1" * 200_000 + "." + "a" * 200_000 + "@")[0] == []


def contact(rng):
    card = "".join(str(rng.randint(0, 9)) for _ in range(15))
    card += next(str(d) for d in range(10) if pii.luhn(card + str(d)))
    return rng.choice([f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", card, f"u{rng.randint(1, 99)}@mail.example.com",
                       ".".join(str(rng.randint(1, 255)) for _ in range(4)), f"{rng.randint(1, 10**9)}", f"{rng.randint(0, 99)}.{rng.randint(0, 99)}"])


def test_trees_part_what_runs_together(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["call", "the", "of", contact(rng) + " now"]) for _ in range(30))) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    detector = pii.fit_detector(df)
    assert detector.trees is not None
    text = "see +1 (269) 555-3296 4111111111111111 today"
    assert [(k, text[a:b]) for k, a, b in detector.spans(text)] == [
        ("likely_phone", "+1 (269) 555-3296"), ("likely_card", "4111111111111111")]
    assert pii.redact_text(text, detector.spans(text)) == "see [PHONE] [CARD] today"
    got = pii.find_personal_data(df, detector=detector)
    for r in got.collect():
        own = [(pii.KINDS.index(s.kind), s.start, s.end) for s in r.spans if s.kind in pii.KINDS]
        assert own == base_by_regex(docs[r.doc_id][1])


def test_personal_data_odd_cases(edge, empty):
    got = pii.find_personal_data(edge)  # too few candidates to learn from
    assert got.count() == len(EDGE) and pii.find_personal_data(empty).count() == 0
    clean = pii.redact(edge)
    assert clean.columns == edge.columns
    texts = {r.text for r in clean.collect()}
    assert "Card [CARD] and token=abcdef123" in texts and "Ünïcödé ΑΒΓ \U0001f600 Über [EMAIL]" in texts and None in texts


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 10, (3000, 4)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 6)).astype(float)
    trees = boosting.fit_boosted(x[:2000], y[:2000])
    assert ((trees.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.98
    assert np.array_equal(trees.predict(x), boosting.fit_boosted(x[:2000], y[:2000]).predict(x))
    assert boosting.threshold_for(np.array([0.9, 0.8, 0.1]), np.array([0.0, 0.0, 1.0]), 0.9) == np.inf


# toxicity

def test_network_gradient_is_right():
    rng = np.random.default_rng(0)
    shapes = dict(wa=(6, 4), va=(4,), wo=(6,), bo=(1,), wf=(toxicity.WIDTH, 9), uf=(3, 9), bf=(9,), wb=(toxicity.WIDTH, 9), ub=(3, 9), bb=(9,))
    net = toxicity.Network(None, 3, {k: rng.standard_normal(s) * 0.5 for k, s in shapes.items()})
    x, ids = rng.standard_normal((7, toxicity.WIDTH)), rng.integers(0, 8, (5, 6))
    ids[0, 3:] = 0
    y, weight = np.array([0, 1, 0, 1, 1.0]), np.array([1, 2, 1, 1, 0.5])

    def loss():
        p = 1 / (1 + np.exp(-net.logits({s: net.project(x, s) for s in "fb"}, ids)))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    g = net.gradient(x, ids, y, weight)
    for name, v in net.p.items():
        for i in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(4)]:
            old = v[i]
            v[i] = old + 1e-3
            up = loss()
            v[i] = old - 1e-3
            slope = (up - loss()) / 2e-3
            v[i] = old
            assert abs(slope - g[name][i]) < 2e-4, name


def toxic_docs(n, seed):
    rng = random.Random(seed)
    common = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    out = []
    for i in range(n):
        w = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randint(0, len(w)), "zwuck" + rng.choice(common))  # a stem with any ending
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_docs(1200, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert 150 < len(held) < 350 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([(r.score >= 0.5) == rows[r.doc_id][2] for r in held]) > 0.95
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(
        toxicity.F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_documents(docs, flipped).collect()}
    assert max(abs(again[r.doc_id] - r.score) for r in got) < 1e-9  # labels of held-out rows are not learned


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        ids, of = toxicity.windows([list(range(1, n + 1)), [1]])
        seen = set(ids[of == 0].ravel()) - {0}
        assert seen == set(range(1, n + 1)) and (of == 1).sum() == 1


def test_a_document_is_its_worst_window():
    rows = toxic_docs(400, 4)
    net = toxicity.train([r[1] for r in rows], np.array([r[2] for r in rows]))
    long = " ".join(r[1] for r in rows if not r[2])
    one, both = net.scores([long, long + " zwuckaa zwucktee"])
    assert both > one
    apart = [net.scores([t])[0] for t in (rows[0][1], None, "", long)]
    assert np.allclose(net.scores([rows[0][1], None, "", long]), apart, atol=1e-5) and apart[1] == apart[2] == 0


def test_toxicity_odd_cases(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (1, 1), (7, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(edge, labels)
    assert got.count() == len(EDGE) and all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.score_documents(empty, labels).count() == 0
    assert {r.score for r in toxicity.score_documents(edge, labels.where("false")).collect()} == {0.0}


# WARC

class PlainText(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.silent, self.links = [], 0, []

    def handle_starttag(self, tag, attrs):
        self.silent += tag in warc.SILENT_TAGS
        self.links += [v for k, v in attrs if k in ("href", "src")]
        self.out.append("\n" if tag in warc.LINE_TAGS else "")

    def handle_endtag(self, tag):
        self.silent -= tag in warc.SILENT_TAGS
        self.out.append("\n" if tag in warc.LINE_TAGS else "")

    def handle_data(self, data):
        self.out.append("" if self.silent else data)


def test_page_text_equals_a_full_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for page in [*pages, "<p>a<b>b</b> &amp; c</p><script>x < y</script>d<br>e", '<a href="x?a=1&amp;b=2" title="a>b">t</a>']:
        p = PlainText()
        p.feed(page)
        p.close()
        text, _, links = warc.page_text(page)
        assert text.split() == "".join(p.out).split() and links == p.links


@pytest.mark.parametrize("page", ["<!-- x", "<script>never", "a < b", "<a href='x", "<" * 20_000, '<a "' * 20_000, "", "<title>t"])
def test_broken_pages_end_soon(page):
    assert isinstance(warc.page_text(page)[0], str)


def test_warc_round_trip(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = warc.derive(warc.responses(pages))
    rows = {r.headers["WARC-Record-ID"]: r for r in made.collect()}
    assert len(rows) == 2 * pages.count()
    warc.write_records(made, str(tmp_path / "out"))
    back = warc.read_records(spark, str(tmp_path / "out" / "*.gz")).collect()
    assert {r.headers["WARC-Record-ID"]: (r.headers, bytes(r.block)) for r in back} == {
        k: (r.headers, r.block.encode()) for k, r in rows.items()}
    sources = {r.headers["WARC-Record-ID"]: r for r in warc.responses(pages).collect()}
    for r in rows.values():
        source = sources[r.headers["WARC-Refers-To"]].headers
        assert r.headers["WARC-Source-Payload-Digest"] == source["WARC-Payload-Digest"]
        assert r.headers["WARC-Block-Digest"] == warc.digest(r.block.encode())
        if r.headers["WARC-Type"] == "metadata":
            assert json.loads(r.block)["warc"] == source


def test_warc_odd_cases(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "é<p>x")], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "1 as headers_", "2 as kind")
    assert warc.derive(warc.responses(pages)).count() == 8
    assert warc.derive(warc.responses(pages.where("false"))).count() == 0
    other = spark.createDataFrame([({"WARC-Type": "request"}, bytearray(b"x"), 5), (None, None, 6), (
        {"WARC-Type": "response"}, bytearray(b"HTTP/1.1 200 OK\r\ncontent-type: image/png\r\n\r\n\xff"), 7)], "headers map<string,string>, block binary, block_ int")
    assert [(r.block_, r.headers["WARC-Type"]) for r in warc.derive(other).collect()] == [(7, "metadata")]


# substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def word_hash(w):
    x = 0
    for k, byte in enumerate(w.encode("utf-8", "surrogatepass")):
        x = (x + ((byte + 32 if 65 <= byte <= 90 else byte) + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64)) % (1 << 64)
    return mix((x + len(w.encode("utf-8", "surrogatepass"))) % (1 << 64))


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % (1 << 64)
    return x ^ (x >> 31)


def cut_by_hand(t):
    """Pieces as (text, words), from the rules: sentence and line ends, and least triples of eight where sentences are long."""
    found = list(WORDS.finditer(t))
    n = len(found)
    if not n:
        return [(t, [])] if t else []
    ends = [bool(re.search(r"""[.!?]["')\]]{0,2}$""", m[0])) or "\n" in t[m.end():(found[i + 1].start() if i + 1 < n else len(t))] or i == n - 1
            for i, m in enumerate(found)]
    h = [word_hash(m[0]) for m in found]
    triple = [mix(((h[i] * 0x9E3779B97F4A7C15) % (1 << 64)) ^ ((mix(h[i + 1]) * 0xD6E8FEB86659FD93) % (1 << 64)) ^ h[i + 2]) for i in range(n - 2)]
    points = set()
    for w in range(-7, n - 2):  # windows may reach over the text's ends
        inside = [i for i in range(w, w + 8) if 0 <= i < n - 2]
        if inside:
            points.add(min(inside, key=lambda i: (triple[i], -i)))
    opens, begin = [], 0
    for i in range(n):
        if ends[i]:
            opens += [k for k in range(begin, i + 1) if k == begin or (i + 1 - begin >= 9 and k in points)]
            begin = i + 1
    places = [0, *[found[k].start() for k in opens[1:]], len(t)]
    return [(t[a:b], ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORDS.findall(t[a:b])]) for a, b in zip(places, places[1:])]


def spans_by_hand(pieces, run, least):
    for a in range(len(pieces)):
        for b in range(a + run, len(pieces) + 1):
            words = [w for _, own in pieces[a:b] for w in own]
            if len(words) >= least:
                yield a, b, tuple(words)
                break


def removed_by_hand(docs, run, least):
    first = {}
    order = sorted({(d is None, d, t) for d, t in docs if t is not None}, key=lambda r: (r[0], r[1] or 0))
    for _, d, t in order:
        for a, _, h in spans_by_hand(cut_by_hand(t), run, least):
            first.setdefault(h, (d, a))
    out = []
    for d, t in docs:
        cut, pieces = set(), cut_by_hand(t or "")
        for a, b, h in spans_by_hand(pieces, run, least):
            if first[h] != (d, a):
                cut.update(range(a, b))
        out.append((d, t if t is None else "".join(p for i, (p, _) in enumerate(pieces) if i not in cut), len(cut)))
    return out


def test_pieces_equal_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice(["ab", "Cd", "é", "x", "yy", "zq7"]) + rng.choice([" ", " ", " ", ". ", "?\" ", "\n", "  ", ".') ", ", "]) for _ in range(rng.randint(0, 60)))
        t = rng.choice(["", " ", "\n"]) + t
        assert substrings.sentences(t) == [p for p, _ in cut_by_hand(t)]
        got = [(a, b) for a, b, _ in substrings.spans_of(t, 3, 6)]
        assert got == [(a, b) for a, b, _ in spans_by_hand(cut_by_hand(t), 3, 6)]


def test_spans_held_by_many_texts_and_segments(spark, monkeypatch):
    rng = random.Random(6)
    shared = " ".join(f"w{i}" for i in range(60)) + "."
    docs = [(i if i % 7 else None, f"{' '.join(f'q{rng.randint(0, 10**6)}' for _ in range(20))} {shared} {' '.join(f'r{rng.randint(0, 10**6)}' for _ in range(20))}") for i in range(150)]
    docs += docs[:20]
    for pack, per in ((1 << 20, 1 << 17), (30, 40)):
        monkeypatch.setattr(substrings, "PACK", pack)
        monkeypatch.setattr(substrings, "PER_SEGMENT", per)
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        got = [tuple(r) for r in substrings.remove_repeats(frame).collect()]
        known = {t: (t2, n) for (_, t), (_, t2, n) in zip(docs, removed_by_hand(docs, 3, 15))}
        named = sorted((str(d), x, n) for d, x, n in got)
        # of null ids, the first is the one with the least print, which only the operator knows
        want = sorted((str(d), x, n) for d, x, n in removed_by_hand(docs, 3, 15))
        assert named == want and len(known) == 150


def test_repeats_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) + rng.choice([". ", "! ", ", ", "\n"]) for _ in range(12)]
    docs = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    got = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), run=3, least_words=6)
    assert sorted(map(tuple, got.collect())) == sorted(removed_by_hand(docs, 3, 6))


def test_a_passage_inside_a_sentence_is_caught(spark):
    rng = random.Random(9)

    def prose(n):
        return " ".join(rng.choice(["lo", "ra", "mi", "tes"]) + str(rng.randint(0, 999)) + ("." if k % 9 == 8 else "") for k in range(n))

    passage = prose(63)
    docs = [(i, f"{prose(40 + i)} {passage} {prose(30)}") for i in range(5)] + [(9, prose(200))]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 and got[9].n_removed == 0
    assert all(got[i].n_removed >= 5 for i in range(1, 5))


def test_repeats_odd_cases(edge, empty):
    got = substrings.remove_repeats(edge)
    assert got.columns == [*edge.columns, "n_removed"] and got.count() == len(EDGE)
    assert [r.n_removed for r in got.where("doc_id = 1").collect()] == [0, 0]  # rows of one id and text are one
    assert substrings.remove_repeats(empty).count() == 0
    assert "".join(substrings.sentences(EDGE[7][1])) == EDGE[7][1]


# SimHash

def simhash_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_by_hand(rows, radius=4):
    """rows (id, fp) -> smallest id reachable."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return [min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(rows))]


def near_copies():
    rng = random.Random(10)
    docs = []
    for g in range(30):
        base = [f"w{rng.randint(0, 999)}" for _ in range(60)]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            if rng.random() < 0.7:
                w[rng.randint(0, 59)] = f"x{rng.randint(0, 999)}"
            docs.append((len(docs), " ".join(w)))
    return docs + [(900, docs[0][1]), (901, docs[0][1].upper()), (902, "a"), (903, "a b")]


@pytest.mark.parametrize("tile_rows", [2048, 3])
def test_near_duplicates_equal_brute_force(spark, tile_rows, monkeypatch):
    docs = near_copies()
    whole = simhash.links
    monkeypatch.setattr(simhash, "links", lambda nodes, radius: whole(nodes, radius, tile_rows))
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), radius=14).collect()}
    prints = [(d, simhash_by_hand(t)) for d, t in docs]
    assert {d: f"{p:016x}" for d, p in prints} == {d: r.fingerprint for d, r in got.items()}
    assert [got[d].component_id for d, _ in docs] == classes_by_hand(prints, 14)
    assert len(set(classes_by_hand(prints, 14))) < len({p for _, p in prints})


def test_components_of_long_chains(spark):
    edges = [(i + 1, i) for i in range(300)] + [(1000, 5), (2001, 2000)]
    random.Random(0).shuffle(edges)
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {v for k, v in got.items() if k <= 1000} == {0} and got[2001] == 2000 and len(got) == 302


def test_near_duplicates_odd_cases(edge, empty):
    rows = simhash.near_duplicates(edge)
    assert rows.count() == len(EDGE) and simhash.near_duplicates(empty).count() == 0
    zero = {r.doc_id: r for r in rows.collect() if r.fingerprint == "0" * 16}
    assert {2, 3, 4} <= set(zero) and {r.component_id for r in zero.values()} == {2}
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted_rows(kept, "doc_id") == [(1,), (2,), (5,), (6,), (7,), (None,)]
    assert simhash.keep_one(empty).count() == 0


def test_fingerprint_of_long_text_in_chunks():
    text = " ".join(f"w{i % 977}" for i in range(5000))
    assert simhash.fingerprint(text, chunk=64) == simhash.fingerprint(text) == simhash_by_hand(text)

"""Personal data by candidate spans and gradient-boosted trees.

The base kinds are patterns with checks and always count.  They miss what runs together: a card number
behind a phone number is one long run of digits to them, and fails as a whole.  So generators propose
overlapping candidates: runs of neighbouring digit groups as phone or card, every four dotted groups as
address, everything around an ``@``.  Boosted trees score each candidate from its format and its
surroundings, and thresholds calibrated on held-out candidates select the spans to add.

There are no labels for personal data, so the trees learn from the base kinds: over all documents a candidate is
positive if it equals a base span and negative if it does not.  Those inside a run of several groups that a base
pattern took whole and then dropped are left out; the trees decide them later.  Trees, their cut points and the
thresholds come from every such candidate; equal ones are counted, so the jobs of the fit read counts, not texts.

Defined results: null or empty text has no spans.  Places are code points of the whole text.  Repeated rows
and null ids give a row each; an empty table gives an empty result.  If there are too few candidates of either
class, only base spans are found.
"""

from __future__ import annotations

import itertools
import math
import re
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torqueline.llm.base import with_text_batches
from torqueline.llm.boosting import Boosted, binned_rows, fit_boosted_rows, thresholds_of_rows, valued, value_cuts
from torqueline.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules[Boosted.__module__])

# fixed values: the base kinds in their order
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
ISLAND = re.compile(r"[0-9](?:[\x20().+-]{0,3}[0-9])*")
GROUP = re.compile(r"[0-9]+")
HOST = re.compile(r"[A-Za-z0-9.-]*")
MAYBE = re.compile(r"[0-9@]")
HINTS = (("mail",), ("tel", "phone", "call", "fax"), ("card", "visa", "credit"), ("ip", "host", "addr"))
MOST_DIGITS = 19
BINS = 32  # quantiles of a feature

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the base kinds, and the runs they dropped that may hold more than one thing."""
    found = [(0, a, b) for a, b in _emails(text)]
    dropped = []
    for m in DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            size = sum(map(len, four)) + 3
            if all(map(_small, four)):
                found.append((1, at, at + size))
            at += size + 1
    for kind, pattern, low, high in ((2, CARD, 14, 19), (3, PHONE, 10, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                found.append((kind, *m.span()))
            elif len(digits) >= low and len(digits) < len(m[0]):
                dropped.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], s[0])), dropped


def candidates(text: str) -> list[Span]:
    """Overlapping proposals of every kind; linear in the text, as a proposal has at most MOST_DIGITS groups and no
    local part reaches back over an ``@``."""
    out: list[Span] = []
    free = 0
    for m in re.finditer("@", text):
        start = free + len(text[free:m.start()].rstrip(LOCAL))
        free = m.end()
        end = m.end() + len(HOST.match(text, m.end())[0].rstrip(".-"))
        if start < m.start() and end > m.end():
            out.append((0, start, end))
    for m in ISLAND.finditer(text):
        groups = [g.span() for g in GROUP.finditer(text, *m.span())]
        for i in range(len(groups)):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > MOST_DIGITS:
                    break
                a, b = groups[i][0], groups[j][1]
                if j == i + 3 and text[a:b].count(".") == 3:
                    out.append((1, a, b))
                if digits >= 13:
                    out.append((2, a, b))
                if 7 <= digits <= 15:
                    lead = text[max(0, a - 2):a]
                    out.append((3, a - (len(lead) - len(lead.rstrip("+("))), b))
    return out


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isdigit() else 2 if c.isalpha() else 3


def features(text: str, span: Span) -> list[float]:
    """Format of a candidate and its surroundings."""
    kind, a, b = span
    s = text[a:b]
    groups = [len(g) for g in GROUP.findall(s)] or [0]
    digits = re.sub("[^0-9]", "", s)
    before, after = text[a - 1:a] if a else "", text[b:b + 1]
    context = text[max(0, a - 24):a].lower()
    host = s.rpartition("@")[2]
    return [
        *(float(kind == k) for k in range(4)), len(s), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1],
        float(bool(digits) and luhn(digits)), s.count("+"), s.count("("), s.count(")"), s.count("-"), s.count("."), s.count(" "),
        float(s[:1] == "+"), _side(before), _side(after), float(before in ("+", "-", ".")), float(after in ("-", ".")),
        host.count(".") if kind == 0 else -1, len(host.rpartition(".")[2]) if kind == 0 else -1,
        float(all(_small(g) for g in GROUP.findall(s))), *(float(any(h in context for h in hints)) for hints in HINTS),
    ]


WIDTH = len(features("1", (2, 0, 1)))


class Stretches:
    """Spans to ask for overlaps, in logarithmic time: places of spans by start, with the greatest end so far."""

    def __init__(self, spans: list[Span]) -> None:
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(itertools.accumulate((b for _, b in ordered), max))

    def meets(self, span: Span) -> bool:
        n = bisect_left(self.starts, span[2])
        return n > 0 and self.ends[n - 1] > span[1]

    def add(self, span: Span) -> None:
        """Add a span that meets none."""
        n = bisect_left(self.starts, span[1])
        self.starts.insert(n, span[1])
        self.ends.insert(n, span[2])


def training_rows(text: str) -> list[tuple[list[float], int]]:
    """(features, label) of the candidates whose label the base patterns settle."""
    if not MAYBE.search(text):
        return []
    found, dropped = base_spans(text)
    sure, unsure = set(found), Stretches(dropped)
    return [(features(text, c), int(c in sure)) for c in candidates(text) if c in sure or not unsure.meets(c)]


@dataclass(frozen=True)
class Detector:
    """Trees and a threshold per kind; without trees only base spans are found."""

    trees: Boosted | None = None
    least: tuple[float, ...] = (1.0,) * 4

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind; added spans are named ``likely_<kind>`` and overlap no others."""
        if not text or not MAYBE.search(text):
            return []
        found, _ = base_spans(text)
        added: list[Span] = []
        base, new = Stretches(found), Stretches([])
        open_ = [c for c in candidates(text) if not base.meets(c)] if self.trees else []
        if open_:
            score = self.trees.predict(np.array([features(text, c) for c in open_]))
            for n in np.argsort(-score, kind="stable"):
                if score[n] >= self.least[open_[n][0]] and not new.meets(open_[n]):
                    added.append(open_[n])
                    new.add(open_[n])
        every = [(a, k, b, KINDS[k]) for k, a, b in found] + [(a, k + len(KINDS), b, f"likely_{KINDS[k]}") for k, a, b in added]
        return [(name, a, b) for a, _, b, name in sorted(every)]


def training_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(held, kind, x, y, n): how often each labelled candidate with the same features occurs; x holds packed floats."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[tuple[bool, int, bytes, int]] = Counter()
            for t, held in zip(b.column("t").to_pylist(), b.column("held").to_pylist(), strict=True):
                for x, y in training_rows(t):
                    found[held, x.index(1.0), np.array(x, np.float32).tobytes(), y] += 1
            held, kind, x, y = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.bool_()), pa.array(kind, pa.int32()), pa.array(x, pa.binary()), pa.array(y, pa.int32()),
                                              pa.array(found.values(), pa.int64())], names=["held", "kind", "x", "y", "n"])

    t = with_text_batches(docs).select(F.col(text).cast("string").alias("t")).where(F.col("t").rlike("[0-9@]"))
    rows = t.select("t", (F.xxhash64("t").bitwiseAND(F.lit(3)) == 0).alias("held"))
    rows = rows.mapInArrow(count, "held boolean, kind int, x binary, y int, n long")
    return settle(rows.groupBy("held", "kind", "x", "y").agg(F.sum("n").alias("n")), "candidates")


def fit_detector(docs: DataFrame, text: str = "text", sample_rows: int | None = None, precision: float = 0.95, seed: int = 42) -> Detector:
    """Trees and thresholds from all documents; from about ``sample_rows`` of them, chosen by a hash of all their columns, only
    if a caller asks for that."""
    if sample_rows is not None:
        share = min(1.0, sample_rows / max(docs.count(), 1))
        plain = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
        docs = docs.where(F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in plain]), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20))))
    rows = training_counts(docs, text)
    many = {(r.held, r.y): r.n for r in rows.groupBy("held", "y").agg(F.sum("n").alias("n")).collect()}
    zeros, ones = many.get((False, 0), 0), many.get((False, 1), 0)
    if sum(many.values()) < 20 or not zeros or not ones:
        return Detector()
    cuts = value_cuts(rows.where("NOT held"), WIDTH, BINS)
    binned = binned_rows(rows, cuts)
    trees = fit_boosted_rows(binned.where("NOT held"), cuts, zeros, ones, bins=BINS)
    return Detector(valued(trees, cuts), thresholds_of_rows(binned.where("held"), trees, len(KINDS), precision))


SPANS = "array<struct<kind:string,start:long,end:long>>"


def span_column(text: Column, detector: Detector) -> Column:
    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in detector.spans(t)] for t in texts.to_pylist()], kind)

    return scan(text)


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", detector: Detector | None = None) -> DataFrame:
    """One row per document: key and its spans."""
    detector = detector or fit_detector(docs, text)
    return with_text_batches(docs).select(F.col(key).alias(key), span_column(F.col(text).cast("string"), detector).alias("spans"))


def redact_text(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each stretch of overlapping spans replaced by the kind of the first, as in ``[EMAIL]``."""
    if not text or not spans:
        return text
    out, free = [], 0
    for kind, a, b in spans:
        if a >= free:
            out += [text[free:a], f"[{kind.removeprefix('likely_').upper()}]"]
        free = max(free, b)
    return "".join(out) + text[free:]


def redact(docs: DataFrame, text: str = "text", detector: Detector | None = None) -> DataFrame:
    """The documents with personal data in ``text`` replaced; all other columns as they came."""
    detector = detector or fit_detector(docs, text)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([redact_text(t, detector.spans(t)) for t in texts.to_pylist()], pa.string())

    return with_text_batches(docs).withColumn(text, clean(F.col(text).cast("string")))

"""Quality rules as a short-circuit cascade.

Every rule states what it measures and the condition under which it rejects a document.
``plan_cascade`` runs each rule on a sample, takes its seconds as cost and its share of rejected
documents as selectivity, and puts the rules with the most rejections per second first.  ``cascade``
measures a rule only on the documents that no earlier rule has rejected.  A document is kept if no rule
rejects it, so the order decides the cost and the named reason, never the verdict.  The whole cascade is one
expression over the text: a CASE whose branches hold the measures, which Spark evaluates in order and no further
than the first that rejects.

Defined results: null text is an empty text, which ``too_short`` rejects.  A text of white space only is
the same.  Repeated rows and null ids are judged row by row, every input column comes back unchanged, and
an empty table gives an empty result.  Texts of any length are read whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torqueline.llm.base import TOKEN, tokens
from torqueline.session import settle

SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, wherever the expression is evaluated."""
    return F.get(F.transform(F.array(value), body), 0)


@dataclass(frozen=True)
class Doc:
    """Text, words and number of words of a document, as expressions; text is not null."""

    text: Column
    words: Column

    @property
    def n_words(self) -> Column:
        return F.size(self.words).cast("long")


@dataclass(frozen=True)
class Rule:
    """``measures`` name the numbers a rule needs; ``reject`` decides on them, in the order they are named."""

    name: str
    measures: dict[str, Callable[[Doc], Column]]
    reject: Callable[..., Column]

    def rejects(self, doc: Doc) -> Column:
        def bound(left: list[Callable[[Doc], Column]], values: list[Column]) -> Column:
            if not left:
                return self.reject(doc, *values)
            return let(left[0](doc), lambda v: bound(left[1:], [*values, v]))

        return bound(list(self.measures.values()), [])


def repeat_words(doc: Doc, size: int = 5) -> Column:
    """Words inside windows of ``size`` words that the text holds more than once.

    Equal hashes only select the texts worth a look; those compare the windows themselves, sorted, so the
    work stays n log n in the words of a text.
    """
    w = doc.words
    starts = F.sequence(F.lit(0), F.size(w) - size)
    zero = F.lit(0).cast("long")

    def same(places: Column, i: Column, x: Column) -> Column:
        return F.coalesce(F.get(places, i)["g"] == x["g"], F.lit(False))

    def covered(places: Column) -> Column:
        twice = F.filter(places, lambda x, i: same(places, i - 1, x) | same(places, i + 1, x))
        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(F.array_sort(F.transform(twice, lambda x: x["at"])), none, lambda a, p: F.struct(
            (a["n"] + p + size - F.greatest(a["end"], p)).alias("n"), (p + size).alias("end")))["n"].cast("long")

    windows = F.sort_array(F.transform(
        starts, lambda i: F.struct(F.array_join(F.slice(w, i + 1, size), " ").alias("g"), i.alias("at"))))
    grams = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    repeated = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), let(windows, covered)).otherwise(zero))
    return F.when(F.size(w) > size, repeated).otherwise(zero)


def symbols(doc: Doc) -> Column:
    return F.regexp_count(doc.text, F.lit(SYMBOLS)).cast("long")


def lines(doc: Doc) -> Column:
    """(n_lines, n_dup_lines): lines with a word, and those equal to an earlier one."""
    return let(F.filter(F.split(doc.text, "\n"), lambda x: x.rlike(TOKEN)), lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))


def word_chars(doc: Doc) -> Column:
    return F.length(F.array_join(doc.words, "")).cast("long")


def stutter(doc: Doc) -> Column:
    """Words equal to the word before."""
    again = F.filter(doc.words, lambda x, i: F.coalesce(x == F.get(doc.words, i - 1), F.lit(False)))
    return F.size(again).cast("long")


def shouts(doc: Doc) -> Column:
    return F.regexp_count(doc.text, F.lit("!")).cast("long")


def rules(
    least_words: int = 10, repeat_window: int = 5, most_repeat_pct: int = 20, most_symbols: float = 0.1,
    most_dup_lines: float = 0.5, most_stutter: float = 0.3, most_shouts: float = 0.4,
    least_word_chars: float = 2.0, most_word_chars: float = 15.0,
) -> list[Rule]:
    """The rules with their limits, most of them per word."""
    return [
        Rule("too_short", {}, lambda d: d.n_words < least_words),
        Rule("repeated_words", {"n_repeat_words": lambda d: repeat_words(d, repeat_window)},
             lambda d, n: F.lit(100) * n > F.lit(most_repeat_pct) * d.n_words),
        Rule("symbols", {"n_symbols": symbols}, lambda d, n: n > most_symbols * d.n_words),
        Rule("repeated_lines", {"lines": lines}, lambda d, ls: ls["n_dup_lines"] > most_dup_lines * ls["n_lines"]),
        Rule("word_length", {"word_chars": word_chars},
             lambda d, n: (n < least_word_chars * d.n_words) | (n > most_word_chars * d.n_words)),
        Rule("stutter", {"n_stutter": stutter}, lambda d, n: n > most_stutter * d.n_words),
        Rule("shouting", {"n_shouts": shouts}, lambda d, n: n > most_shouts * d.n_words),
    ]


def plan_cascade(docs: DataFrame, using: list[Rule], text: str = "text", sample_rows: int = 1000, seed: int = 42) -> list[Rule]:
    """Order the rules by rejections per second on about ``sample_rows`` rows.

    The sample decides only the order.  Costs are wall-clock seconds less those of a job that reads the
    words alone.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    t = F.coalesce(F.col(text), F.lit(""))
    sample = settle(docs.select(t.alias("t"), tokens(t).alias("w")).sample(share, seed), "rules")
    doc = Doc(F.col("t"), F.col("w"))

    def run(hit: Column) -> tuple[float, float]:
        start = time.perf_counter()
        rate = sample.agg(F.avg(F.coalesce(hit, F.lit(False)).cast("double"))).first()[0] or 0.0
        return time.perf_counter() - start, rate

    run(F.size("w") < 0)
    floor = run(F.size("w") < 0)[0]
    gain = {}
    for rule in using:
        cost, rate = run(rule.rejects(doc))
        gain[rule.name] = rate / max(cost - floor, 1e-3)
    return sorted(using, key=lambda r: -gain[r.name])


def rejected_by(text: Column, ordered: list[Rule]) -> Column:
    """The first rule in this order that rejects the text, else null; later rules are not evaluated."""
    def verdict(doc: Doc) -> Column:
        out = F.when(ordered[0].rejects(doc), F.lit(ordered[0].name))
        for rule in ordered[1:]:
            out = out.when(rule.rejects(doc), F.lit(rule.name))
        return out

    return let(F.coalesce(text, F.lit("")), lambda t: let(tokens(t), lambda w: verdict(Doc(t, w))))


def filter_documents(docs: DataFrame, text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The documents that pass every rule, with the columns they came with."""
    ordered = plan_cascade(docs, rules(), text, sample_rows)
    return docs.where(rejected_by(F.col(text), ordered).isNull())


def judge_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """One row per document: key, n_words, every measure, and ``rejected_by`` in the order of the cascade."""
    using = rules()
    ordered = plan_cascade(docs, using, text, sample_rows)
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(key).alias("_key"), t.alias("_t"), tokens(t).alias("_w"))
    doc = Doc(F.col("_t"), F.col("_w"))
    found = {name: measure(doc) for rule in using for name, measure in rule.measures.items()}
    d = d.select("_key", doc.n_words.alias("n_words"), *[m.alias(name) for name, m in found.items()])
    # the measures are there, so only the comparisons are left
    counted = _Counted(F.lit(""), F.array())
    chain = F.when(F.lit(False), F.lit(""))
    for rule in ordered:
        chain = chain.when(rule.reject(counted, *[F.col(name) for name in rule.measures]), F.lit(rule.name))
    return d.select(F.col("_key").alias(key), "n_words", *[c for c in found if c != "lines"], "lines.n_lines", "lines.n_dup_lines",
                    chain.alias("rejected_by"))


class _Counted(Doc):
    """A document whose words are counted in a column."""

    @property
    def n_words(self) -> Column:
        return F.col("n_words")

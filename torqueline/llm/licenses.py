"""License scan by diagonal voting.

Notices of known licenses are templates, cut into rolling word k-grams.  Every k-gram of every document is
joined with the template places it stands at; the words are compared, so a hash collision is no hit.  A hit
votes for its diagonal, document place minus template place.  Neighbouring diagonals, which a few
inserted or lost words separate, are merged, and a span is verified by the share of the template's k-grams
it holds and by its length.  A base phrase counts only on a single diagonal that holds all its k-grams.

Only hits and one row per document are shuffled, once, by document.  The template table is a parameter of
bounded size and is broadcast.

Defined results: null or empty text has no words and no labels, score 0.  Repeated rows and null ids
give a row each.  An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from torqueline.llm.grams import positions

# fixed values: phrases that always count, with their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# fixed values: short notices in common use, with the label each one stands for
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}


def template_rows(base: dict[str, str], notices: dict[str, str], k: int) -> list[tuple]:
    """(template, label, is_base, n_words, n_grams, place, gram words) for every k-gram."""
    rows = []
    for n, (text, label, is_base) in enumerate([(t, x, True) for t, x in base.items()] + [(t, x, False) for t, x in notices.items()]):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        if len(w) < k:
            raise ValueError(f"a template needs {k} words: {text}")
        rows += [(n, label, is_base, len(w), len(w) - k + 1, p, w[p:p + k]) for p in range(len(w) - k + 1)]
    return rows


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] | None = None,
    notices: dict[str, str] | None = None, k: int = 2, most_shift: int = 2, least_share: float = 0.8,
    most_stretch: float = 1.25,
) -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    rows = template_rows(BASE if base is None else base, NOTICES if notices is None else notices, k)
    schema = "template int, label string, is_base boolean, length int, n_grams int, place int, gram array<string>"
    templates = spark.createDataFrame(rows, schema).withColumn("hash", F.xxhash64(*[F.get("gram", i) for i in range(k)]))
    itself = spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in templates.dtypes if c != "hash"],
                                   F.lit(0).cast("long").alias("hash"))
    at = positions(docs, key, text)
    behind = F.col("pos") == F.col("n_words")
    here = [F.get("words", F.col("pos") + i) for i in range(k)]
    at = at.withColumn("hash", F.when(behind, F.lit(0).cast("long")).otherwise(F.xxhash64(*here)))
    equal = F.lit(True)
    for i, word in enumerate(here):
        equal = equal & F.coalesce(word == F.get("gram", i), F.lit(False))
    hits = at.join(F.broadcast(templates.unionByName(itself)), "hash").where(
        F.when(F.col("template").isNull(), behind).otherwise(~behind & equal))
    hits = hits.select("id", "print", "n_words", "template", "label", "is_base", "length", "n_grams", "place",
                       (F.col("pos") - F.col("place")).alias("diagonal")).repartition("id", "print")

    voted = hits.groupBy("id", "print", "template", "diagonal").agg(
        F.max("n_words").alias("n_words"), F.max("label").alias("label"), F.max("is_base").alias("is_base"),
        F.max("length").alias("length"), F.max("n_grams").alias("n_grams"),
        F.collect_set("place").alias("places"), F.count("*").alias("rows"))
    in_order = Window.partitionBy("id", "print", "template").orderBy("diagonal")
    shift = F.when(F.col("is_base"), F.lit(0)).otherwise(F.lit(most_shift))
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > shift, F.lit(True))
    merged = voted.withColumn("band", F.sum(apart.cast("int")).over(in_order)).groupBy("id", "print", "template", "band").agg(
        F.max("n_words").alias("n_words"), F.max("label").alias("label"), F.max("is_base").alias("is_base"),
        F.max("rows").alias("rows"), F.min("diagonal").alias("diagonal"),
        F.max(F.size("places") / F.col("n_grams")).alias("single"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.max("n_grams")).alias("all"),
        ((F.max(F.col("diagonal") + F.array_max("places")) + k - F.min(F.col("diagonal") + F.array_min("places")))
         / F.max("length")).alias("stretch"))
    whole = F.when(F.col("is_base"), F.col("single") == 1).otherwise(
        (F.col("single") >= least_share) | ((F.col("all") >= least_share) & (F.col("stretch") <= most_stretch)))
    share = F.when((F.col("stretch") <= most_stretch), F.greatest("single", "all")).otherwise(F.col("single"))
    merged = merged.withColumns({"ok": F.coalesce(whole, F.lit(False)), "share": share})
    sure = F.col("ok") & F.col("is_base")
    named = lambda condition: F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")
    out = merged.groupBy("id", "print").agg(
        F.max("n_words").alias("n_words"), F.max(F.when(F.col("template").isNull(), F.col("rows"))).alias("rows"),
        F.count(F.when(sure, 1)).alias("n_base"), F.min(F.when(sure, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(sure, F.col("diagonal"))).cast("long").alias("last_word"), named(sure).alias("base_labels"),
        named(F.col("ok")).alias("labels"), F.coalesce(F.max(F.when(F.col("ok"), F.col("share"))), F.lit(0.0)).alias("score"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return out.select(F.col("id").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every source gets a budget of words: its weight's share of ``ratio`` times all words, at most ``most_epochs``
times its own size, the excess going to the other sources by weight until none is above its limit.  A
source takes every document once per complete epoch in its budget.  What is left is filled by weighted
sampling without replacement: each document gets the key ``-ln(u) / weight`` with u from a hash of its id and
its quality as weight, keys are sorted within the source, sizes are summed in that order, and documents are
taken as long as at least half of each lies inside the rest.

Scale: texts are read once; a compact table of sizes and keys is written to the shared folder.  The sorted
prefix sums are two-level.  Keys are cut into ranges of about ``rows_per_range`` documents, one small
aggregate gives the size below each range, and windows sort one range at a time, so a source with a third
of all rows is as many tasks as its rows need.  Only the table of sources, one row each, is handled in one
task.

Defined results: null or empty text has size 0 and takes nothing.  Null source is a source of its own,
ordered last.  Rows of one id share u; ties go by id, size and a hash of the text, and equal rows are
interchangeable.  If all sizes are 0, targets are 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torqueline.llm.base import TOKEN
from torqueline.session import settle


def quality_weight(text: Column, size: Column) -> Column:
    """Share of words without junk symbols, at least a tenth."""
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]"))
    return F.greatest(F.lit(0.1), 1.0 - F.least(F.lit(1.0), symbols / F.greatest(size, F.lit(1)).cast("double")))


def uniform(key: Column, salt: str) -> Column:
    """A repeatable number in (0, 1) for a key."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(16**13))


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), ratio: tuple[int, int] = (3, 2), most_epochs: int = 2,
) -> DataFrame:
    """Words to take per source, from one row (source, total, rows, ...) per source.

    A source stops at its limit if the level, words per unit of weight, that fills the budget reaches the
    source's own level.  With sources ordered by their level, the level that would fill the budget if all
    before a source stood at their limits rises as long as those do and falls after, so its greatest is the one.
    """
    up, down = ratio
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    each = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.withColumn("weight", F.get(each, (F.row_number().over(by_name) - 1) % len(weights)).cast("long"))
    cap = F.lit(most_epochs) * F.col("total")
    s = s.withColumn("level", cap / F.col("weight").cast("double"))
    so_far = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rest = F.lit(up) * F.sum("total").over(every) / F.lit(float(down)) - F.coalesce(F.sum(cap).over(so_far), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(so_far), F.lit(0))
    s = s.withColumn("share", rest / weight.cast("double"))
    fill = F.max("share").over(every)
    return s.withColumn("target", F.least(cap.cast("double"), F.col("weight") * fill))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), ratio: tuple[int, int] = (3, 2), most_epochs: int = 2,
    rows_per_range: int = 2_000, salt: str = "mix:",
) -> DataFrame:
    """One row per document: key, size, source, source_size, target, epochs, taken."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), t.alias("t"))
    d = d.withColumn("size", F.regexp_count("t", F.lit(TOKEN)).cast("long"))
    d = d.select("id", "source", "size", F.xxhash64("t").alias("print"),
                 quality_weight(F.col("t"), F.col("size")).alias("quality"))
    d = settle(d.withColumn("key", -F.log(uniform(F.col("id"), salt)) / F.col("quality")), "mix")

    sums = d.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("rows"), F.avg("quality").alias("rate"))
    plan = settle(targets(sums, weights, ratio, most_epochs).select(
        F.col("source").alias("of"), "total", "target", "rate", F.ceil(F.col("rows") / rows_per_range).alias("ranges")), "targets")
    d = d.join(plan, F.col("source").eqNullSafe(F.col("of")))
    # 1 - exp(-key * mean weight) is close to uniform, so ranges hold about equally many rows
    d = d.withColumn("range", F.least(
        F.floor((1.0 - F.exp(-F.col("key") * F.col("rate"))) * F.col("ranges")), F.col("ranges") - 1).cast("long"))

    below = d.groupBy("source", "range").agg(F.sum("size").alias("held")).withColumn("below", F.coalesce(F.sum("held").over(
        Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    below = below.select(F.col("source").alias("b_source"), F.col("range").alias("b_range"), "below")
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size", "print")
    d = d.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    d = d.join(below, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("range") == F.col("b_range")))

    epochs = F.when(F.col("total") == 0, F.lit(0)).otherwise(
        F.least(F.lit(most_epochs), F.floor(F.col("target") / F.col("total"))))
    d = d.withColumn("epochs", epochs.cast("long"))
    rest = F.when(F.col("epochs") >= most_epochs, F.lit(0.0)).otherwise(F.col("target") - F.col("epochs") * F.col("total"))
    drawn = F.when(F.col("below") + F.col("before") + F.col("size") / 2.0 <= rest, F.col("size")).otherwise(F.lit(0))
    return d.select(
        F.col("id").alias(key), "size", "source", F.col("total").alias("source_size"), "target", "epochs",
        (F.col("size") * F.col("epochs") + drawn).cast("long").alias("taken"))

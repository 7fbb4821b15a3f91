"""Joins of a small table of word k-grams against every position of every document.

The small side is broadcast in blocks of a fixed number of rows, so its size in memory is bounded however
large it grows; each block costs one more pass over the texts.  The words of a document stay in the row
until the join has decided, so nothing of a text is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torqueline.llm.base import words

BLOCK_ROWS = 100_000


def gram_hash(array: Column, start: Column | int, size: int) -> Column:
    """Hash of ``size`` words from ``start``, mixed with the size."""
    return F.xxhash64(F.lit(size), *[F.get(array, start + i) for i in range(size)])


def text_print(text: str) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def positions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A row per word of every document and one row behind its last word: id, print, words, n_words, pos.

    The row behind the last word stands for the document itself, so documents without a match are not
    lost and need no second join.
    """
    d = docs.select(F.col(key).alias("id"), text_print(text).alias("print"),
                    words(F.col(text)).alias("words"))
    d = d.withColumns({"n_words": F.size("words").cast("long"), "_all": F.array_append("words", F.lit(""))})
    return d.select("id", "print", "n_words", "words", F.posexplode("_all").alias("pos", "_word")).drop("_word")


def with_grams(at: DataFrame, sizes: list[int]) -> DataFrame:
    """Add ``gram``: the hash of the words from ``pos``, in a row per size; 0 behind the last word."""
    behind = F.col("pos") == F.col("n_words")
    hashes = [F.when(behind, F.lit(0).cast("long")).otherwise(gram_hash(F.col("words"), F.col("pos"), s)) for s in sizes]
    if len(hashes) == 1:
        return at.withColumn("gram", hashes[0]).withColumn("size", F.lit(sizes[0]))
    rows = [F.struct(F.lit(s).alias("size"), h.alias("gram")) for s, h in zip(sizes, hashes, strict=True)]
    return at.withColumn("_g", F.explode(F.array(*rows))).select("*", "_g.size", "_g.gram").drop("_g").where(
        ~behind | (F.col("size") == sizes[0]))


def blocks(small: DataFrame, key: str = "gram", rows: int = BLOCK_ROWS) -> list[DataFrame]:
    """Parts of ``small`` by its key with about ``rows`` rows each."""
    n = -(-max(small.count(), 1) // rows)
    return [small.where(F.pmod(F.col(key), F.lit(n)) == i) if n > 1 else small for i in range(n)]


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def covered(spans: Column) -> Column:
    """Number of places inside sorted, possibly overlapping (start, end) spans."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(F.array_sort(spans), none, lambda a, x: F.struct(
        (a["n"] + F.greatest(x["end"] - F.greatest(a["end"], x["start"]), F.lit(0).cast("long"))).alias("n"),
        F.greatest(a["end"], x["end"]).alias("end")))["n"]

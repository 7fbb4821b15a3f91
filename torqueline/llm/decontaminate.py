"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (an item with fewer words is one window), a
window into shingles of ``shingle`` words.  A document contains a window only if it contains all of its
shingles, so for exact containment the prefix of a window, its shingles ordered by rarity over the whole
corpus, needs one token: the rarest.  A first pass counts the items' shingles in the corpus; a window with
a shingle that the corpus lacks is dropped at once.  A second pass joins every document position with the
prefix tokens, applies the length and position bounds (the window must begin and end inside the document)
and compares the words themselves over the item-sized window.

Only hits and one row per document are shuffled.  Benchmarks of any size are broadcast in blocks.  Lists of
items are built once per distinct set of windows, so a passage in a third of all documents is resolved once.

Defined results: null or empty text has no words and is clean.  Null or empty item texts have no windows.
An item without an id marks words but is not listed.  Repeated item rows count once; repeated document rows
give a row each.  Empty tables give an empty result, or clean documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torqueline.llm.base import words
from torqueline.llm.grams import BLOCK_ROWS, blocks, covered, gram_hash, positions, text_print, union_of, with_grams
from torqueline.session import settle


def item_windows(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(item, window) for every run of ``window`` words of an item, or the whole of a shorter one."""
    i = items.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    i = i.withColumn("len", F.least(F.size("w"), F.lit(window)))
    return i.select("item", "w", "len", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("s")).select(
        "item", F.expr("slice(w, s + 1, len)").alias("window")).distinct()


def _shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(wid, window, size, offset, gram) for every shingle of every window."""
    parts = []
    for size in range(1, shingle + 1):
        n = F.size("window")
        fits = n >= size if size == shingle else n == size
        parts.append(windows.where(fits).select(
            "wid", "window", F.lit(size).alias("size"), F.explode(F.sequence(F.lit(0), n - size)).alias("offset")
        ).withColumn("gram", gram_hash(F.col("window"), F.col("offset"), size)))
    return union_of(parts)


def contamination(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = 10, shingle: int = 5, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per document: key, n_words, n_hit, spans (start and end words of the hits), items."""
    found = _found(docs, items, key, text, item_key, item_text, window, shingle, block_rows)
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return found.select(F.col("id").alias(key), "n_words", covered(F.col("spans")).alias("n_hit"), "spans", "items")


def _found(
    docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, window: int, shingle: int,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per id and text: id, print, n_words, rows (how many documents), spans, wids, items."""
    listed = settle(item_windows(items, item_key, item_text, window), "windows")
    windows = settle(listed.select("window").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    tokens = settle(_shingles(windows, shingle), "shingles")
    sizes = sorted(r[0] for r in tokens.select("size").distinct().collect()) or [shingle]

    at = with_grams(positions(docs, key, text), sizes)
    fits = F.col("pos") + F.col("size") <= F.col("n_words")
    counts = settle(union_of([
        at.where(fits).select("gram").join(F.broadcast(part), "gram").groupBy("gram").agg(F.count("*").alias("seen"))
        for part in blocks(tokens.select("gram").distinct(), rows=block_rows)]), "rarity")

    rarest = tokens.join(counts, "gram", "left").groupBy("wid", "window").agg(F.min(F.struct(
        F.coalesce(F.col("seen"), F.lit(0)).alias("seen"), "gram", "offset", "size")).alias("first"))
    prefix = settle(rarest.where("first.seen > 0").select(
        "wid", "window", "first.gram", "first.offset", F.col("first.size").alias("token_size")), "prefix")

    start = F.col("pos") - F.col("offset")
    length = F.size("window")
    inside = (start >= 0) & (start + length <= F.col("n_words")) & (F.col("size") == F.col("token_size"))
    found = F.when(inside, F.slice("words", F.greatest(start, F.lit(0)) + 1, length) == F.col("window"))
    itself = prefix.sparkSession.range(1).select(
        F.lit(None).cast("long").alias("wid"), F.lit(None).cast("array<string>").alias("window"),
        F.lit(0).cast("long").alias("gram"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("int").alias("token_size"))
    hits = []
    for n, part in enumerate(blocks(prefix, rows=block_rows)):
        part = part.unionByName(itself) if n == 0 else part
        behind = F.col("pos") == F.col("n_words")
        joined = at.join(F.broadcast(part), "gram").where(F.when(F.col("wid").isNull(), behind).otherwise(~behind & found))
        hits.append(joined.select(
            "id", "print", "n_words", "wid",
            F.when(F.col("wid").isNotNull(), F.struct(
                start.cast("long").alias("start"), (start + length).cast("long").alias("end"))).alias("span")))
    per_doc = settle(union_of(hits).groupBy("id", "print").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(F.col("wid").isNull(), 1)).alias("rows"),
        F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("wid")).alias("wids")), "hits")

    dirty = per_doc.where(F.size("wids") > 0)
    sets = dirty.select("wids").distinct()
    named = listed.join(windows, "window").select("wid", "item")
    items_of = sets.select("wids", F.explode("wids").alias("wid")).join(named, "wid").groupBy("wids").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    clean = per_doc.where(F.size("wids") == 0).withColumn("items", F.array().cast("array<string>"))
    return dirty.join(items_of, "wids").unionByName(clean)


def clean_documents(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = 10, shingle: int = 5,
) -> DataFrame:
    """The documents that contain no window of any item, with the columns they came with."""
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = _found(inner, items, "_key", "_text", item_key, item_text, window, shingle)
    dirty = found.where(F.size("wids") > 0).select("id", F.col("print"))
    inner = inner.withColumn("_print", text_print("_text"))
    same = F.col("_key").eqNullSafe(F.col("id")) & (F.col("_print") == F.col("print"))
    return inner.join(dirty, same, "left_anti").select("_row.*")

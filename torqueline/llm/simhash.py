"""SimHash near-duplicates by tiled exact comparison.

A text's fingerprint has a bit set if the bit is set in over half of the hashes of its word shingles.
Fingerprints link if at most ``radius`` bits differ.  Equal fingerprints become one node first.  Nodes are put
into tiles by the population counts of the four 16-bit quarters; two fingerprints within the radius have
quarter counts that differ by the radius in total at most, so all other tile pairs are skipped without loss
(about 92 of 100 for even bits).  The remaining pairs of tiles meet in a Spark join and are compared in full
with numpy exclusive-or and bit counts, in blocks that fit the cache.  A crowded tile is split into parts of
about ``tile_rows``, so a task never holds more than two parts.  A pair of tiles returns the trees that connect
its linked nodes, not its links, so a large group of near copies does not multiply.  Components follow by
alternating large and small stars over written edge tables.

Comparisons grow with the square of the distinct fingerprints, divided by about 25 through the tiles; that is
the price of the method.

Defined results: null, empty or blank text has fingerprint 0 and links like any other.  Rows of one id are nodes
of their own fingerprints.  ``component_id`` is the smallest id reachable, ignoring null ids; null if there
is none.  An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torqueline.llm.base import with_text_batches
from torqueline.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

QUARTER = 17  # population counts of 16 bits


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42, chunk: int = 1 << 16) -> int:
    """Unsigned 64-bit SimHash over the XXH64 of space-joined word shingles, A-Z in lower case."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(found))
    spans = zip(starts[:len(found) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)
    counts, n = np.zeros(64, np.int64), 0
    while part := [xxh64_intdigest(joined[a:b], seed) for a, b in itertools.islice(spans, chunk)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, print, fp) per row; fp is the fingerprint as a signed long, print tells texts of one id apart."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    t = F.coalesce(F.col(text), F.lit(""))
    return with_text_batches(docs).select(F.col(key).alias("id"), F.xxhash64(t).alias("print"), simhash(t).alias("fp"))


def _quarter(i: int):
    return F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)))


def _tiles(nodes: DataFrame, tile_rows: int) -> DataFrame:
    """(cell, quarter counts, part, fps): nodes with equal quarter counts, in parts of about ``tile_rows``."""
    n = nodes.select("fp", *[_quarter(i).alias(f"q{i}") for i in range(4)])
    n = n.withColumn("cell", sum((F.col(f"q{i}") * QUARTER**i for i in range(4)), F.lit(0)))
    crowd = n.groupBy("cell").agg(F.ceil(F.count("*") / tile_rows).alias("parts"))  # at most 17^4 rows
    n = n.join(F.broadcast(crowd), "cell").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    return n.groupBy("cell", "part", *[f"q{i}" for i in range(4)]).agg(F.collect_list("fp").alias("fps"))


def _forest(x: np.ndarray, y: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its tree) over all links between two tiles, or within one."""
    nodes = x if same else np.concatenate([x, y])
    label = np.arange(len(nodes))
    rows = max(1, (1 << 17) // max(len(y), 1))
    x, y = x.view(np.uint64), y.view(np.uint64)  # bit counts of signed numbers are those of their magnitude
    for a in range(0, len(x), rows):
        near = np.bitwise_count(x[a:a + rows, None] ^ y[None, :]) <= radius
        if same:
            near &= np.arange(len(y))[None, :] > np.arange(a, a + len(near))[:, None]
        for i in np.flatnonzero(near.any(axis=1)):
            met = np.flatnonzero(near[i]) + (0 if same else len(x))
            labels = np.unique(label[np.append(met, a + i)])
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
    linked = np.flatnonzero(np.bincount(label, minlength=len(nodes))[label] > 1)
    if not len(linked):
        return nodes[:0], nodes[:0]
    least = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(least, label[linked], nodes[linked])
    root = least[label[linked]]
    away = nodes[linked] != root
    return nodes[linked][away], root[away]


def links(nodes: DataFrame, radius: int, tile_rows: int = 2048) -> DataFrame:
    """Edges (u, v), u > v, that connect exactly the nodes (column fp) that links of the radius connect."""
    tiles = settle(_tiles(nodes, tile_rows), "tiles")
    reach = range(-radius, radius + 1)
    # half of the neighbouring cells, as each pair of cells meets once; the cell itself is the first
    steps = sorted(s for s in itertools.product(reach, repeat=4) if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0))
    moves = F.explode(F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps]))
    left = tiles.select("*", moves.alias("step"))
    ends = [F.col(f"q{i}") + F.col("step")[i] for i in range(4)]
    for e in ends:
        left = left.where(e.between(0, 16))
    left = left.select(F.col("fps").alias("x"), F.col("cell").alias("x_cell"), F.col("part").alias("x_part"),
                       sum((e * QUARTER**i for i, e in enumerate(ends)), F.lit(0)).alias("cell"))
    pairs = left.join(tiles.select("cell", "part", F.col("fps").alias("y")), "cell")
    pairs = pairs.where((F.col("x_cell") != F.col("cell")) | (F.col("x_part") <= F.col("part"))).select(
        "x", "y", ((F.col("x_cell") == F.col("cell")) & (F.col("x_part") == F.col("part"))).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, x_at), (y, y_at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(0), batch.column(1)))
            same = batch.column(2).to_pylist()
            found = [_forest(x[x_at[i]:x_at[i + 1]], y[y_at[i]:y_at[i + 1]], same[i], radius) for i in range(batch.num_rows)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges but the roots; root is the least node of its component.

    Alternates large stars (every greater neighbour to the least of the neighbourhood) and small stars (the
    node and its lesser neighbours to the least) until the edges are stars: one edge a node, none from a root.
    """
    e = settle(edges.distinct(), "edges")
    for _ in range(most_rounds):
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up > 0 AND up + down > 1").count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """Nodes (fp, root, first): every fingerprint, the least of its component, its smallest id."""
    nodes = settle(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    trees = components(links(nodes, radius).where("u > v"))
    return nodes.join(trees, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("moved"), "first")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id."""
    prints = settle(fingerprints(docs, key, text, shingle), "prints")
    nodes = settle(_grouped(prints, radius), "components")
    named = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.select("fp", "root").join(named, "root").select("fp", "component_id")
    out = prints.join(named, "fp")
    return out.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One document of each group, the one with the smallest id (null ids last), with the columns it came with."""
    prints = settle(fingerprints(docs, key, text, shingle), "prints")
    return best_of_groups(docs, key, text, prints, _grouped(prints, radius).select("fp", "root"))


def best_of_groups(docs: DataFrame, key: str, text: str, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """The document with the smallest id of each root, from (id, print, fp) per row and (fp, root) per node."""
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "print")
    # copies of one row are counted before the choice, so a hot group is one row per task
    rows = prints.groupBy("fp", "id", "print").count().join(roots, "fp").groupBy("root").agg(
        F.min(F.struct(rank.alias("rank"), "count")).alias("best"))
    best = settle(rows.select(F.col("best.rank.id").alias("_id"), F.col("best.rank.print").alias("_print"),
                              F.col("best.count").alias("_rows")), "kept")
    d = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"),
                    F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_text_print"))
    d = d.join(best, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text_print") == F.col("_print")))
    single = d.where("_rows = 1").select("_row.*")
    # a repeated row stays once; empty for tables whose rows differ
    repeated = d.where("_rows > 1").groupBy("_id", "_print").agg(F.first("_row").alias("_row")).select("_row.*")
    return single.unionByName(repeated)

"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns.  It is named by its depth and two sums of hashes of (place, role,
text), which are prefix sums along a conversation, so a parent's name is a node's name less its last hash.  Every
node gets an enter and an exit arc.  The tour goes from an enter arc to the first child's or to the own exit, from
an exit arc to the next sibling's enter or to the parent's exit.  The list of arcs is ranked distributedly by
pointer jumping: in each round every arc adds what its successor has gathered and takes over the successor's
successor, so after the binary logarithm of the arcs every arc knows its place and the sums from its place to the
end.  The sums of a subtree are the difference between those at its enter and its exit arc.

No group is held by one task: turns and siblings are sorted by range and looked along per partition, in pointer
jumping every arc has one predecessor and one successor.  Only the SHA-256 of a node's ends is a stream in one task.

Defined results: null role or text is empty; rows of one turn follow role and text; rows without a conversation id
belong to no conversation; a conversation can be left without turns and then ends at the root; an empty table has
no nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torqueline.llm.base import tokens
from torqueline.llm.ordered import following, in_order, joined_sha256, running
from torqueline.session import settle

NAME = ["depth", "s1", "s2"]


def _hashes(place: Column) -> dict[str, Column]:
    """Two hashes of a turn at its place, as decimals whose sums cannot overflow."""
    return {f"t{i}": F.xxhash64(F.lit(i), place.cast("long"), "role", "text").cast("decimal(20,0)") for i in (1, 2)}


def ordered_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, role, text, place, part): turns numbered from 1 within their conversation."""
    t = rows.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = in_order(t, ["conv", "turn", "role", "text"], ["conv", "turn", "role", F.left("text", F.lit(64))], "turns")
    return running(placed, ["conv"], {"place": F.lit(1)}).drop("turn")


def shared_starts(turns: DataFrame, span: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuild every conversation c with the first h turns of c - c % span in place of its own first h.

    h is crc32 of the decimal c modulo ``most``.  Returns the rebuilt turns (conv, role, text, depth, part, ord)
    and the conversations (conv, size).
    """
    turns = settle(turns, "placed")
    own = turns.groupBy("conv").agg(F.max("place").alias("own"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = own.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % span).alias("base"))
    bases = own.select(F.col("conv").alias("base"), F.col("own").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("kept", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = convs.withColumn("size", F.col("kept") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = settle(convs.select("conv", "base", "h", "kept", "size"), "conversations")

    tail = turns.join(convs.select("conv", "h", "kept", "size"), "conv").where("place > h").select(
        "conv", "role", "text", (F.col("place") - F.col("h") + F.col("kept")).alias("depth"), "part", "size")
    # a base has at most ``most - 1`` turns to give, to at most ``span`` conversations
    heads = turns.where((F.col("place") < most) & (F.col("conv") % span == 0)).select(F.col("conv").alias("base"), "role", "text", "place")
    head = convs.where("kept > 0").join(heads, "base").where("place <= h").select(
        "conv", "role", "text", F.col("place").alias("depth"), F.lit(-1).alias("part"), "size")
    return tail.unionByName(head), convs.select("conv", "size")


def nodes_of(rebuilt: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, name, parent's name, conv_id, n_convs, own savings), and (conv, name) of every conversation's end."""
    hashed = rebuilt.withColumns(_hashes(F.col("depth")))
    named = running(hashed, ["conv"], {"s1": F.col("t1"), "s2": F.col("t2")}, "depth").select(
        "conv", "depth", *[F.col(c).cast("decimal(38,0)").alias(c) for c in ("s1", "s2", "t1", "t2")],
        F.size(tokens(F.col("text"))).alias("words"), (F.col("depth") == F.col("size")).alias("ends"))
    named = settle(named, "named")
    zero = F.lit(0).cast("decimal(38,0)")
    grown = named.groupBy(*NAME).agg(
        F.max("t1").alias("t1"), F.max("t2").alias("t2"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    root = convs.groupBy().agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), zero.alias("s1"), zero.alias("s2"), zero.alias("t1"), zero.alias("t2"), "conv_id", "n_convs",
        F.lit(0).alias("words"))
    nodes = grown.unionByName(root).select(
        F.monotonically_increasing_id().alias("id"), *NAME, (F.col("s1") - F.col("t1")).cast("decimal(38,0)").alias("p1"),
        (F.col("s2") - F.col("t2")).cast("decimal(38,0)").alias("p2"), "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    ends = named.where("ends").select("conv", *NAME).unionByName(
        convs.where("size = 0").select("conv", F.lit(0).cast("long").alias("depth"), zero.alias("s1"), zero.alias("s2")))
    return settle(nodes, "nodes"), ends


def tour_of(tree: DataFrame) -> DataFrame:
    """(arc, next, leaves, saved) of the Euler tour; arc 2 * id enters a node, arc 2 * id + 1 leaves it.

    ``tree`` has id, parent, first (child, null for leaves), sibling (the next one, null for the last) and saved.
    """
    inward = F.struct(
        (2 * F.col("id")).alias("arc"), F.coalesce(2 * F.col("first"), 2 * F.col("id") + 1).alias("next"),
        F.col("first").isNull().cast("long").alias("leaves"), F.col("saved").cast("long").alias("saved"))
    outward = F.struct(
        (2 * F.col("id") + 1).alias("arc"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("next"),
        F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    return tree.select(F.explode(F.array(inward, outward)).alias("a")).select("a.*")


def ranked(arcs: DataFrame, sums: list[str]) -> DataFrame:
    """(arc, rank, sums): arcs from here to the end of the list, and the sums over them, both inclusive."""
    sums = ["rank", *sums]
    now = settle(arcs.withColumn("rank", F.lit(1).cast("long")), "arcs")
    while now.where("next IS NOT NULL").limit(1).count():
        ahead = now.select(F.col("arc").alias("met"), F.col("next").alias("beyond"), *[F.col(c).alias(f"_{c}") for c in sums])
        # arcs that have reached the end stay apart: their null would be one join key
        jumped = now.where("next IS NOT NULL").join(ahead, F.col("next") == F.col("met")).select(
            "arc", F.col("beyond").alias("next"), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])
        now = settle(jumped.unionByName(now.where("next IS NULL").select("arc", "next", *sums)), "arcs")
    return now.drop("next")


def prefix_trie(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                span: int = 20, most: int = 4) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rebuilt, convs = shared_starts(ordered_turns(rows, key, turn, role, text), span, most)
    nodes, ends = nodes_of(rebuilt, convs)

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"),
                           F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.where("depth > 0").join(parents, ["depth", "p1", "p2"]).select(
        "id", *NAME, "conv_id", "n_convs", "saved", "parent", "parent_conv_id")
    tops = nodes.where("depth = 0").select("id", *NAME, "conv_id", "n_convs", "saved", F.lit(None).cast("long").alias("parent"),
                                           F.lit(None).cast("long").alias("parent_conv_id"))
    placed = in_order(linked.unionByName(tops), ["parent", "id"], name="siblings")
    children = placed.groupBy("parent").agg(F.min("id").alias("first"), F.count("*").alias("n_children")).where("parent IS NOT NULL")
    tree = following(placed, ["parent"], "id", "sibling").join(children.withColumnRenamed("parent", "id"), "id", "left")
    tree = settle(tree.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "tree")

    places = ranked(tour_of(tree), ["leaves", "saved"])
    sign = F.when(F.col("arc") % 2 == 0, 1).otherwise(-1)
    under = places.groupBy(F.shiftright("arc", 1).alias("id")).agg(
        F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens"))

    digests = joined_sha256(ends.withColumn("said", F.col("conv").cast("string")), NAME, ["conv"], "said", ",", "ends_sha256")
    out = tree.drop("saved").join(under, "id").join(digests, NAME, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))

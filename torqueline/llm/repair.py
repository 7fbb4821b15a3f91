"""Repair of conversations by iterative-deepening A*.

A conversation's rows carry a fault (blank, duplicate, truncated) and a role.  The cheapest edits that leave role
initials ``(s?(ua)+)?`` are searched depth first, in the ASCII order of the edits, under a bound on the cost that
rises from one round to the next to the least cost that broke it.  A table of failed states keeps the largest
remaining budget with which a place and state was left without success.  The first accepting path is the answer:
it is the cheapest, and of these the least in ASCII order.

The whole rows are sorted by range and cut into blocks of at most ``BLOCK`` rows, so a conversation of any length
spreads over tasks.  A conversation in one block is searched directly.  For others, each block first gives the
costs from each of the four entry states to each exit state; going backwards over a conversation's blocks turns
these into the cost that remains behind each block, which the search of a block adds at its end; each entry state is
searched, and going forwards over the blocks picks the entries.  Inserts stand before the row they precede, behind
the last row only at the end, so the choice made block by block is the choice of the whole search.  One task sees
16 costs per block of a conversation, never its rows; only the SHA-256 of a conversation's text is a stream in one
task, as that digest is sequential.

Defined results: null role or text is one space; rows of null conversation ids form one conversation; rows of one
turn follow role and text; a role outside s, u, a by its first character is rerolled or deleted; an empty table
gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torqueline.llm.ordered import in_order, joined, joined_sha256
from torqueline.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

BLOCK = 128
SPACE = " \t\n\x0b\f\r"
FAULTS = ("none", "blank", "duplicate", "truncated")
#: states of the pattern: nothing yet, s, open u, complete pair
START, SYSTEM, OPEN, PAIR = range(4)
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
FAR = 1 << 40


def _after_user(state: int) -> int | None:
    return OPEN if state != OPEN else None


def _after_assistant(state: int) -> int | None:
    return PAIR if state == OPEN else None


def _kept(state: int, initial: int) -> int | None:
    if initial == 0:
        return SYSTEM if state == START else None
    return _after_user(state) if initial == 1 else _after_assistant(state) if initial == 2 else None


def _made(state: int) -> tuple[int, str]:
    """The state behind, and the initial of, the one role that a rerole or an insert can give here."""
    return (PAIR, "a") if state == OPEN else (OPEN, "u")


def search(codes: list[int], entry: int = START, ends: list[int] | None = None) -> tuple[int, int, str] | None:
    """(cost, exit state, edits) of the cheapest, then ASCII-least, path over rows given as initial + 4 * fault.

    ``ends`` are the costs that remain behind the rows by exit state; without it the path must end the pattern
    here, with inserts behind the last row if need be.
    """
    n = len(codes)
    rest = [0] * (n + 1)
    rest[n] = min(ends) if ends else 0
    for i in range(n - 1, -1, -1):
        initial, fault = codes[i] & 3, codes[i] >> 2
        rest[i] = rest[i + 1] + (DELETE if fault else REROLE if initial == 3 else 0)
    bound = rest[0]

    def dfs(i: int, state: int, left: int) -> bool:
        nonlocal beyond, leaving
        need = rest[i]
        if i == n and ends:
            need = ends[state]
        if need > left:
            beyond = min(beyond, bound - left + need)
            return False
        if i == n and (ends or state in (START, PAIR)):
            leaving = (state, left - (need if ends else 0))
            return True
        if failed.get((i, state), -1) >= left:
            return False
        if i < n:
            path.append("D")
            if dfs(i + 1, state, left - DELETE):
                return True
            path.pop()
        made = _made(state)[0]
        if i < n or not ends:
            path.append("I")
            if dfs(i, made, left - INSERT):
                return True
            path.pop()
        if i < n and (fault := codes[i] >> 2) not in (1, 2):
            left_kept = left - (CUT if fault == 3 else 0)
            kept = _kept(state, codes[i] & 3)
            if kept is not None:
                path.append("K")
                if dfs(i + 1, kept, left_kept):
                    return True
                path.pop()
            path.append("R")
            if dfs(i + 1, made, left_kept - REROLE):
                return True
            path.pop()
        failed[i, state] = left
        return False

    while bound < FAR:
        failed: dict[tuple[int, int], int] = {}
        path: list[str] = []
        beyond, leaving = FAR, None
        if dfs(0, entry, bound):
            state, left = leaving
            return bound - left - (ends[state] if ends else 0), state, "".join(path)
        bound = beyond
    return None


def crossing(codes: list[int]) -> np.ndarray:
    """Least cost from every entry state to every exit state over the rows, without inserts behind the last row."""
    best = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    for code in codes:
        initial, fault = code & 3, code >> 2
        opened = best.copy()
        for _ in range(2):  # two inserts reach every state that inserts can reach
            opened[:, OPEN] = np.minimum(opened[:, OPEN], opened[:, [START, SYSTEM, PAIR]].min(axis=1) + INSERT)
            opened[:, PAIR] = np.minimum(opened[:, PAIR], opened[:, OPEN] + INSERT)
        best = opened + DELETE
        if fault not in (1, 2):
            extra = CUT if fault == 3 else 0
            for state in range(4):
                for to, cost in ((_kept(state, initial), extra), (_made(state)[0], extra + REROLE)):
                    if to is not None:
                        best[:, to] = np.minimum(best[:, to], opened[:, state] + cost)
    return np.minimum(best, FAR)


#: cost behind the last row, by state
FINAL = [0, 2 * INSERT, INSERT, 0]


def written_out(codes: list[int], audit: str, entry: int) -> list[tuple[str, str, str | None, str]]:
    """(roles inserted before, edit, new role, roles inserted behind) of every row."""
    out, before, state = [], "", entry
    roles = {"u": "user", "a": "assistant"}
    for edit in audit:
        if edit == "I":
            state, initial = _made(state)
            before += initial
            continue
        role = None
        if edit == "K":
            state = _kept(state, codes[len(out)] & 3)
        elif edit == "R":
            state, initial = _made(state)
            role = roles[initial]
        out.append([before, edit, role, ""])
        before = ""
    if before and out:
        out[-1][3] = before
    return [tuple(x) for x in out]


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) of conversations with faults that follow from crc32 of ``key:turn``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(key), F.lit(":"), part(turn)).cast("binary")) % 20
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("said", ".!?", "")).otherwise(F.col("said"))
    d = rows.select(F.col(key).alias("conv"), F.col(turn).alias("turn"), part(role).alias("as"), part(text).alias("said"), kind.alias("kind"))
    d = d.where("kind <> 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("as")).alias("role"), said.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return d.drop("copy")


def inspected(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows in order with ord and part, and (conv, ord, code) with code = initial (s, u, a, other) + 4 * fault."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    found = rows.select(
        "conv", "turn", "role", "text", (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).isin(*".!?").alias("ended"),
        F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2"))
    placed = in_order(found, ["conv", "turn", "role", "text"], ["conv", "turn", "role", F.left("text", F.lit(64))], "turns")
    said = ["conv", "h1", "h2"]
    seen = placed.where(~F.col("blank")).groupBy(*said).agg(F.min("ord").alias("first"), F.count("*").alias("times"))
    codes = joined(placed.select("ord", *said, "blank", "ended", F.left("role", F.lit(1)).alias("initial")), seen.where("times > 1").drop("times"), said)
    fault = F.when(F.col("blank"), 1).when(F.col("ord") > F.col("first"), 2).when(~F.col("ended"), 3).otherwise(0)
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    codes = settle(codes.select("conv", "ord", (initial + 4 * fault).alias("code")), "codes")
    return placed.drop("h1", "h2", "blank", "ended"), codes


def _blocks(codes: DataFrame) -> DataFrame:
    """(conv, block, ords, codes, blocks): at most BLOCK rows each."""
    block = F.shiftrightunsigned("ord", BLOCK.bit_length() - 1)
    rows = codes.groupBy("conv", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("ord", "code"))).alias("rows"))
    w = Window.partitionBy("conv")
    return rows.select("conv", "block", F.col("rows.ord").alias("ords"), F.col("rows.code").alias("codes"),
                       F.count("*").over(w).alias("blocks"), F.max("block").over(w).alias("last"))


def _remaining(blocks: DataFrame) -> DataFrame:
    """(conv, block, ends): the cost that remains behind each block of conversations of several blocks."""
    @F.pandas_udf("array<long>")
    def costs(codes: pd.Series) -> pd.Series:
        return pd.Series([crossing(list(c)).ravel() for c in codes])

    many = blocks.where("blocks > 1").select("conv", "block", costs("codes").alias("costs"))

    def backwards(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        behind, out = np.array(FINAL, np.int64), []
        for c in reversed(rows["costs"].tolist()):
            out.append(behind.tolist())
            behind = np.minimum((np.asarray(c).reshape(4, 4) + behind[None, :]).min(axis=1), FAR)
        return pd.DataFrame({"conv": rows["conv"], "block": rows["block"], "ends": out[::-1]})

    kind = blocks.schema["conv"].dataType.simpleString()
    return many.groupBy("conv").applyInPandas(backwards, f"conv {kind}, block long, ends array<long>")


def plans(codes: DataFrame) -> DataFrame:
    """(conv, block, cost, audit, edits) of every block; edits are (ord, before, edit, role, after) per row."""
    blocks = settle(_blocks(codes), "blocks")
    alone = blocks.where("blocks = 1").withColumn("ends", F.lit(None).cast("array<long>"))
    many = joined(blocks.where("blocks > 1"), _remaining(blocks), ["conv", "block"], "inner")
    kind = blocks.schema["conv"].dataType.simpleString()
    edit = "array<struct<ord:long,before:string,edit:string,role:string,after:string>>"

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                c = [int(x) for x in r.codes]
                ends = None if r.block == r.last else [int(x) for x in r.ends]
                for entry in range(4 if r.blocks > 1 else 1):
                    found = search(c, entry, ends)
                    if found:
                        cost, leaving, audit = found
                        edits = [(int(o), *e) for o, e in zip(r.ords, written_out(c, audit, entry), strict=True)]
                        out.append((r.conv, r.block, r.blocks, entry, leaving, cost, audit, edits))
            yield pd.DataFrame(out, columns=["conv", "block", "blocks", "entry", "leaving", "cost", "audit", "edits"])

    solved = settle(alone.unionByName(many).mapInPandas(
        solve, f"conv {kind}, block long, blocks long, entry int, leaving int, cost long, audit string, edits {edit}"), "solved")

    def forwards(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = START, []
        for block, ways in rows.sort_values("block").groupby("block"):
            out.append((rows["conv"].iloc[0], block, state))
            state = int(ways.loc[ways["entry"] == state, "leaving"].iloc[0])
        return pd.DataFrame(out, columns=["conv", "block", "entry"])

    ways = solved.where("blocks > 1").select("conv", "block", "entry", "leaving")
    taken = ways.groupBy("conv").applyInPandas(forwards, f"conv {kind}, block long, entry int")
    several = joined(solved.where("blocks > 1"), taken, ["conv", "block", "entry"], "inner")
    return settle(solved.where("blocks = 1").unionByName(several).drop("blocks", "entry", "leaving"), "plans")


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv, ord, at, edit, role, text) of the repaired conversations, in the order of ord, at."""
    e = planned.select(F.explode("edits").alias("e")).select("e.*")
    both = rows.select("conv", "ord", F.col("role").alias("had"), "text").join(e, "ord")
    kept = F.when(F.col("edit") != "D", F.struct(
        F.lit(2).alias("at"), F.col("edit").alias("edit"), F.coalesce("role", "had").alias("role"), F.col("text").alias("text")))
    roles = F.create_map(F.lit("u"), F.lit("user"), F.lit("a"), F.lit("assistant"))

    def inserted(column: str, place: int, start: int) -> Column:
        initial = F.substring(column, place + 1, 1)
        return F.when(initial != "", F.struct(F.lit(start + place).alias("at"), F.lit("I").alias("edit"),
                                              roles[initial].alias("role"), F.lit("").alias("text")))

    pieces = F.array(inserted("before", 0, 0), inserted("before", 1, 0), kept, inserted("after", 0, 3), inserted("after", 1, 3))
    return both.select("conv", "ord", F.explode(F.array_compact(pieces)).alias("p")).select("conv", "ord", "p.*")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (conv, turn, role, text): one row per conversation, and the repaired rows.

    A conversation has gaps (missing turn numbers), counts of blank, duplicate, truncated and illegal (adjacent
    roles out of pattern), cost, audit (the edits in order) and repaired_sha256 (its ``role:text`` lines).
    """
    placed, codes = inspected(rows)
    planned = plans(codes)
    mended = repaired(placed, planned)

    code = F.col("code")
    faults = codes.groupBy("conv").agg(*[
        F.count_if(F.floor(code / 4) == i).alias(name) for i, name in enumerate(FAULTS) if i])
    turns = placed.groupBy("conv", "turn").count().groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    # pairs inside blocks, and between a block and the one before it
    initials = F.transform("codes", lambda c: c % 4)
    b = _blocks(codes).select("conv", "block", initials.alias("i"))
    before = F.lag(F.element_at("i", -1)).over(Window.partitionBy("conv").orderBy("block"))
    b = b.select("conv", F.when(before.isNull(), F.col("i")).otherwise(F.concat(F.array(before), "i")).alias("i"))
    pair = F.zip_with("i", F.slice("i", 2, F.greatest(F.size("i") - 1, F.lit(1))), lambda x, y: 4 * x + y)
    legal = F.filter(pair, lambda p: p.isin(1, 6, 9))  # su, ua, au
    illegal = b.groupBy("conv").agg(F.sum(F.size("i") - 1 - F.size(legal)).cast("long").alias("illegal"))
    order = F.array_sort(F.collect_list(F.struct("block", "audit")))
    audits = planned.groupBy("conv").agg(F.sum("cost").alias("cost"), F.array_join(order["audit"], "").alias("audit"))
    digests = joined_sha256(mended.withColumn("line", F.concat("role", F.lit(":"), "text")), ["conv"], ["ord", "at"], "line", "\n", "repaired_sha256")

    out = turns
    for more in (faults, illegal, audits, digests):
        out = joined(out, more, ["conv"])
    return out, mended


def repair_damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per conversation of ``rows``, repaired after :func:`damage`; zeros where no row is left."""
    out, _ = repair_conversations(damage(rows, key, turn, role, text))
    every = rows.select(F.col(key).alias("conv")).distinct()
    every = joined(every, out, ["conv"])
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.select(F.col("conv").alias(key), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

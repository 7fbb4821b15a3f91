"""Conversation repair and prefix trie against brute force, with odd rows and conversations cut into many pieces."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from functools import cache
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from torqueline.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, ord int, part int, codes int, depth int, id int"
SPACE = " \t\n\x0b\f\r"


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def repaired_by_hand(rows):
    """Every edit sequence, by plain recursion over (row, initials so far), least by cost and then by edits."""
    if not rows:
        return 0, "", []
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.strip(SPACE)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))

    def valid(s):
        return re.fullmatch(r"s?(ua)*u?", s) is not None

    @cache
    def best(i, shape):
        """shape: the last two initials kept so far, enough to go on."""
        found = []
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", shape):
            found.append((0, "", ()))
        for role in ("user", "assistant"):
            after = grow(shape, role[0])
            if after is not None and depth[0] < 2:
                depth[0] += 1
                tail = best.__wrapped__(i, after)
                depth[0] -= 1
                if tail:
                    found.append((tail[0] + 5, "I" + tail[1], (f"{role}:",) + tail[2]))
        if i < len(rows):
            _, role, text = rows[i]
            tail = follow(i + 1, shape)
            if tail:
                found.append((tail[0] + 2, "D" + tail[1], tail[2]))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                for edit, to, cost in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    after = grow(shape, to[:1])
                    tail = follow(i + 1, after) if after is not None else None
                    if tail:
                        found.append((tail[0] + cost + extra, edit + tail[1], (f"{to}:{text}",) + tail[2]))
        return min(found) if found else None

    def follow(i, shape):
        held, depth[0] = depth[0], 0
        out = best(i, shape)
        depth[0] = held
        return out

    def grow(shape, initial):
        new = shape + initial
        if not initial or not valid(new):
            return None
        return new if len(new) < 5 else new[:1] * (new[0] == "s") + new[-2:] if new[-1] == "a" else new[:1] * (new[0] == "s") + new[-3:]

    depth = [0]
    return best(0, "")


def summary_by_hand(conv_rows):
    out = {}
    for conv, original in conv_rows.items():
        rows = []
        for turn, role, text in original:
            kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if kind == 0:
                continue
            if kind == 1:
                text = ""
            if kind == 2:
                text = re.sub("[.!?]", "", text)
            if kind == 4:
                role = "user"
            rows += [(turn, role, text)] * (2 if kind == 3 else 1)
        rows = by_turn(rows)
        seen, faults = set(), []
        for _, role, text in rows:
            said = text.strip(SPACE)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in rows if t is not None}
        initials = [r[:1] for _, r, _ in rows]
        cost, audit, lines = repaired_by_hand(tuple(rows))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(lines)))
    return out


def made_up(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", "Why?", "Well, then", "A. ", "Ünï!", None]
    rows = []
    for conv in [*range(conversations), None]:
        for _ in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""]), rng.choice(texts)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("block", [128, 4])
def test_repair_equals_brute_force(spark, monkeypatch, block):
    rows = made_up(3, 60, 9)
    monkeypatch.setattr(repair, "BLOCK", block)
    groups = defaultdict(list)
    for c, *r in rows:
        groups[c].append(tuple(r))
    want = summary_by_hand(groups)
    got = repair.repair_damaged(frame(spark, rows)).collect()
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_search_by_blocks_equals_search_of_the_whole(monkeypatch):
    rng = random.Random(8)
    for _ in range(60):
        codes = [rng.choice([0, 1, 1, 2, 2, 3]) + 4 * rng.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(rng.randint(1, 14))]
        cost, _, audit = repair.search(codes)
        size = rng.randint(1, 5)
        parts = [codes[i:i + size] for i in range(0, len(codes), size)]
        ends = [repair.FINAL]
        for p in reversed(parts[1:]):
            ends.append((repair.crossing(p) + ends[-1]).min(axis=1).tolist())
        ends, state, total, said = ends[::-1], repair.START, 0, ""
        for i, p in enumerate(parts):
            c, state, a = repair.search(p, state, None if i == len(parts) - 1 else ends[i])
            total, said = total + c, said + a
        assert (total, said) == (cost, audit)


def test_a_long_conversation_spreads_over_blocks(spark):
    rng = random.Random(2)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"Line {i}.") for i in range(1500)]
    out = repair.repair_conversations(repair.damage(frame(spark, rows)))[0].collect()
    assert len(out) == 1 and out[0]["cost"] > 0 and set(out[0]["audit"]) <= set("DIKR")
    shape, state = {"K": 0, "R": 0, "D": 0}, out[0]["audit"]
    assert sum(state.count(k) for k in shape) == repair.damage(frame(spark, rows)).count()


def test_repaired_rows_follow_the_pattern(spark):
    _, mended = repair.repair_conversations(repair.damage(frame(spark, made_up(11, 40, 8))))
    roles = mended.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("ord", "at", "role")))["role"].alias("roles")).collect()
    assert roles and all(re.fullmatch(r"(s?(ua)+)?", "".join(x[:1] for x in r["roles"])) for r in roles)


def trie_by_hand(rows):
    groups = defaultdict(list)
    for c, *r in rows:
        if c is not None:
            groups[c].append((r[0], r[1] or "", r[2] or ""))
    groups = {c: [(x, t) for _, x, t in by_turn(g)] for c, g in groups.items()}
    rebuilt = {}
    for c, own in groups.items():
        h = crc32(str(c).encode()) % 4
        rebuilt[c] = groups.get(c - c % 20, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, r in rebuilt.items():
        for d in range(len(r) + 1):
            nodes[tuple(r[:d])].append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        saved = sum((len(nodes[p]) - 1) * len([w for w in re.split(f"[{SPACE}]+", p[-1][1]) if w]) for p in below if p)
        leaves = sum(not any(q[:-1] == p for q in nodes if q) for p in below)
        ends = sorted(c for c in members if len(rebuilt[c]) == len(path))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
                 sum(1 for q in nodes if q and q[:-1] == path), leaves, saved, sha(",".join(map(str, ends)))))
    return out


def test_trie_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["a b", "a", "", None, "c  d\te", "a b"]
    ids = [*range(0, 45), *range(61, 70), 101]
    rows = [(c, rng.choice([None, 1, 2, 3, 4]), rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in ids for _ in range(rng.randint(1, 6))]
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    assert {tuple(r) for r in trie.prefix_trie(frame(spark, rows)).collect()} == trie_by_hand(rows)


def test_trie_of_many_equal_conversations(spark):
    rows = [(c, t, "user", "same words here") for c in range(400) for t in range(3)]
    got = {tuple(r) for r in trie.prefix_trie(frame(spark, rows)).collect()}
    assert got == trie_by_hand(rows)


def test_empty_conversations(spark):
    none = frame(spark, made_up(1, 1, 1)).where("false")
    assert repair.repair_damaged(none).count() == 0 and trie.prefix_trie(none).count() == 0

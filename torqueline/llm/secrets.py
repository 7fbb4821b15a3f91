"""Secret scan with one combined deterministic automaton.

All rules are compiled by subset construction and minimisation into one transition array that a match may enter
at any byte.  A batch of texts is scanned in one pass: every text is a lane, and one numpy step moves all lanes by a
byte.  Between two visits to the start state no match is under way, so a place where the automaton accepts
belongs to a stretch that begins at the last such visit.  Only from these stretches the automaton of the rule
that accepted goes on, for leftmost non-overlapping spans; spans shorter than the rule asks for are dropped.

Defined results: null or empty text has no spans.  Places are code points of the whole text.  Repeated rows and
null ids give a row each; an empty table gives an empty result.  Memory follows the Arrow batch, whose rows and
bytes are bounded.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torqueline.llm.automaton import Automaton, compile_rules
from torqueline.llm.base import with_text_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules[Automaton.__module__])


@dataclass(frozen=True)
class Rule:
    """``pattern`` decides what a match takes; it counts if ``group`` has ``least`` characters.

    ``scan`` is what the combined automaton looks for in its place: the head every match begins with, or
    matches long enough to count.  Counters and open ends of many rules would multiply its states.
    """

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    ignore_case: bool = False
    scan: str = ""


# fixed values: the base kinds, then token formats that providers document
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24, scan=r"[0-9a-f]{24,}"),
)
PROVIDERS = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40, scan=r"gh[pousr]_[A-Za-z0-9]"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39, scan=r"AIza[A-Za-z0-9_-]"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15, scan=r"xox[abprs]-[A-Za-z0-9-]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, scan=r"eyJ[A-Za-z0-9_-]"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
FEW_LANES = 48
STEPS = 256
LONG_TRAIL = 64


class Scanner:
    """The compiled rules; ``spans`` works on a batch of UTF-8 texts."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.all = compile_rules([(r.scan or r.pattern, r.ignore_case) for r in rules], search=True)
        self.each = [compile_rules([(r.pattern, r.ignore_case)], search=False) for r in rules]
        self.step = (self.all.step * 256).astype(np.int32).ravel()  # states stand as their row's place

    def stretches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], int]:
        """(text, first byte in the text) of every stretch with an accepted rule, with the rules' bits."""
        found: dict[tuple[int, int], int] = {}
        order = np.argsort(starts - ends, kind="stable")  # longest first, so running lanes stay in front
        at, size = starts[order], (ends - starts)[order]
        state, last = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        limit, accepts = self.all.first_accepting * 256, self.all.accepts
        t = 0
        while len(size) and t < size[0]:
            k = int(np.searchsorted(-size, -t))
            if k < FEW_LANES:
                break
            # bytes of the next steps, one row per step; a lane that ends sooner reads on into its neighbour
            rows = min(STEPS, int(size[0]) - t)
            here = np.minimum(at[:k] + t + np.arange(rows)[:, None], len(data) - 1)
            block = data[here]
            for row in block:
                n = int(np.searchsorted(-size[:k], -t))
                s = state[:n]
                np.take(self.step, s + row[:n], out=s)
                np.putmask(last[:n], s == 0, t + 1)
                if n and s.max() >= limit:
                    for lane in np.flatnonzero(s >= limit):
                        key = (int(order[lane]), int(last[lane]))
                        found[key] = found.get(key, 0) | int(accepts[s[lane] >> 8])
                t += 1
        for lane in range(int(np.searchsorted(-size, -t))):
            text, s, since = data[at[lane] + t:at[lane] + size[lane]].tobytes(), int(state[lane]), int(last[lane])
            step = self.all_rows
            s >>= 8
            for i, byte in enumerate(text, t):
                s = step[s][byte]
                if not s:
                    since = i + 1
                elif s >= self.all.first_accepting:
                    key = (int(order[lane]), since)
                    found[key] = found.get(key, 0) | int(accepts[s])
        return found

    @property
    def all_rows(self) -> list[list[int]]:
        if not hasattr(self, "_rows"):
            self._rows = self.all.step.tolist()
            self._each_rows = [(a.step.tolist(), (a.accepts != 0).tolist(), self._dead(a)) for a in self.each]
            self._tests = [re.compile(r.pattern, re.I if r.ignore_case else 0) for r in self.rules]
        return self._rows

    @staticmethod
    def _dead(a: Automaton) -> int:
        """The state that nothing leaves and that accepts nothing."""
        stuck = [s for s in range(len(a.step)) if not a.accepts[s] and (a.step[s] == s).all()]
        return stuck[0] if stuck else -1

    def resolve(self, text: bytes, stretches: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, rule) of the spans that begin in the stretches (first byte, rules' bits) of a text."""
        step, out, free = self.all_rows, [], [0] * len(self.rules)
        for since, bits in stretches:
            s, to = 0, since
            while to < len(text):
                s = step[s][text[to]]
                to += 1
                if not s:
                    break
            for n in range(len(self.rules)):
                if bits >> n & 1:
                    found, free[n] = self._of_rule(n, text, max(since, free[n]), to)
                    out += found
        return out

    def _of_rule(self, n: int, text: bytes, i: int, to: int) -> tuple[list[tuple[int, int, int]], int]:
        """Spans of a rule that begin from ``i`` before ``to``, and where the next may begin."""
        rows, accepting, dead = self._each_rows[n]
        out, first = [], i
        # by place, the state in which a run met no accept any more; a later run that comes to it ends there, so long
        # runs that share their tail cost it once
        failed: list[int] | None = None
        while i < to:
            s, end, mark, trail, j = 0, 0, i, [], i
            while j < len(text):
                s = rows[s][text[j]]
                if s == dead or failed and failed[j - first] == s:
                    break
                j += 1
                if accepting[s]:
                    end = mark = j
                    trail = []
                else:
                    trail.append(s)
            if len(trail) > LONG_TRAIL:
                failed = failed or [-1] * (len(text) - first)
                failed[mark - first:mark - first + len(trail)] = trail
            if end:
                m = self._tests[n].fullmatch(text[i:end].decode("ascii"))
                if m and len(m[self.rules[n].group]) >= self.rules[n].least:
                    out.append((i, end, n))
            i = end or i + 1
        return out, i

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, end, rule) in code points for every text, by start, then rule."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(1, np.uint8)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        found: dict[int, list[tuple[int, int]]] = {}
        for (n, since), bits in sorted(self.stretches(data, offsets[:-1], offsets[1:]).items()):
            found.setdefault(n, []).append((since, bits))
        for n, stretches in found.items():
            text = data[offsets[n]:offsets[n + 1]]
            points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
            out[n] = sorted((int(points[a]), int(points[b]), r) for a, b, r in self.resolve(text.tobytes(), stretches))
        return out


SPANS = "array<struct<kind:string,start:long,end:long>>"


def span_column(text: Column, rules: tuple[Rule, ...] = BASE + PROVIDERS) -> Column:
    """Array of (kind, start, end) for a text column."""
    scanner = Scanner(rules)

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        kinds = [r.kind for r in scanner.rules]
        return pa.array([[{"kind": kinds[r], "start": a, "end": b} for a, b, r in found] for found in scanner.spans(texts)],
                        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return scan(text)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + PROVIDERS) -> DataFrame:
    """One row per document: key and its spans."""
    return with_text_batches(docs).select(F.col(key).alias(key), span_column(F.col(text).cast("string"), rules).alias("spans"))

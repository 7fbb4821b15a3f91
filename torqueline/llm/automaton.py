"""Regular expressions to one minimal deterministic automaton over bytes.

The syntax is what scanning rules need: literals, escapes ``\\.`` and ``\\xNN``, classes with ranges, groups,
``|``, ``?``, ``*``, ``+`` and ``{m}``, ``{m,}``, ``{m,n}``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_TOKEN = re.compile(r"\\x[0-9A-Fa-f]{2}|\\.|\[\^?\]?(?:\\.|[^\]])*\]|\{\d+(?:,\d*)?\}|\(\?:|.", re.S)


@dataclass(frozen=True)
class Automaton:
    """``step[state, byte]`` is the next state and ``accepts[state]`` the bits of the rules that match there.

    State 0 is the start.  Accepting states have the highest numbers, from ``first_accepting``.
    """

    step: np.ndarray
    accepts: np.ndarray
    first_accepting: int


def _char(token: str) -> int:
    return int(token[2:], 16) if token[:2] == "\\x" else ord(token[-1])


def _byte_set(token: str, ignore_case: bool) -> frozenset[int]:
    if token[0] != "[" or len(token) == 1:
        found = {_char(token)}
    else:
        inner = re.findall(r"\\x[0-9A-Fa-f]{2}|\\.|.", token[1:-1], re.S)
        negated = inner[:1] == ["^"]
        inner, found = inner[negated:], set()
        while inner:
            low = _char(inner.pop(0))
            if len(inner) > 1 and inner[0] == "-":
                found |= set(range(low, _char(inner[1]) + 1))
                inner = inner[2:]
            else:
                found.add(low)
        found = set(range(256)) - found if negated else found
    if ignore_case:
        found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
    return frozenset(found)


class _Nfa:
    """Thompson's construction: states with one byte set to another state, or empty moves."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.moves) - 1

    def add(self, pattern: str, ignore_case: bool) -> tuple[int, int]:
        tokens = _TOKEN.findall(pattern)
        ends, rest = self._either(tokens, ignore_case)
        if rest:
            raise ValueError(f"unbalanced: {pattern}")
        return ends

    def _either(self, tokens: list[str], ic: bool) -> tuple[tuple[int, int], list[str]]:
        start, end = self.state(), self.state()
        while True:
            (a, b), tokens = self._sequence(tokens, ic)
            self.empty[start].append(a)
            self.empty[b].append(end)
            if tokens[:1] != ["|"]:
                return (start, end), tokens
            tokens = tokens[1:]

    def _sequence(self, tokens: list[str], ic: bool) -> tuple[tuple[int, int], list[str]]:
        start = end = self.state()
        while tokens and tokens[0] not in "|)":
            (a, b), after = self._atom(tokens, ic)
            q = after[0] if after and (after[0] in "?*+" or re.fullmatch(r"\{\d+(,\d*)?\}", after[0])) else ""
            low, high = {"": (1, 1), "?": (0, 1), "*": (0, None), "+": (1, None)}.get(q) or self._bounds(q)
            for n in range(max(low, high or 0, 1)):
                if n:  # a copy of the atom, built anew
                    (a, b), _ = self._atom(tokens, ic)
                self.empty[end].append(a)
                if n >= low:
                    self.empty[end].append(b)
                if high is None and n == max(low, 1) - 1:
                    self.empty[b].append(a)
                end = b
                if high == 0:
                    self.empty[a].append(b)
            tokens = after[1:] if q else after
        return (start, end), tokens

    @staticmethod
    def _bounds(q: str) -> tuple[int, int | None]:
        low, _, high = q[1:-1].partition(",")
        return int(low), int(high) if high else None if "," in q else int(low)

    def _atom(self, tokens: list[str], ic: bool) -> tuple[tuple[int, int], list[str]]:
        if tokens[0] in ("(", "(?:"):
            ends, rest = self._either(tokens[1:], ic)
            return ends, rest[1:]
        a, b = self.state(), self.state()
        self.moves[a] = (_byte_set(tokens[0], ic), b)
        return (a, b), tokens[1:]

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if self.moves[s] or not self.empty[s])


def compile_rules(patterns: list[tuple[str, bool]], search: bool) -> Automaton:
    """One automaton for all (pattern, ignore case); with ``search`` a match may begin at every byte."""
    nfa = _Nfa()
    ends, starts = {}, []
    for bit, (pattern, ignore_case) in enumerate(patterns):
        a, b = nfa.add(pattern, ignore_case)
        starts.append(a)
        ends[b] = bit
    first = nfa.closure(set(starts))
    # bytes that every set treats alike form a class
    sets = list(dict.fromkeys(m[0] for m in nfa.moves if m))
    kinds: dict[tuple, list[int]] = {}
    for byte in range(256):
        kinds.setdefault(tuple(byte in s for s in sets), []).append(byte)

    rows, numbers, todo = [], {first: 0}, [first]
    for states in todo:
        row = np.zeros(256, np.int64)
        for members in kinds.values():
            to = {nfa.moves[s][1] for s in states if nfa.moves[s] and members[0] in nfa.moves[s][0]}
            nxt = nfa.closure(to) | (first if search else frozenset())
            if nxt not in numbers:
                numbers[nxt] = len(todo)
                todo.append(nxt)
            row[members] = numbers[nxt]
        rows.append(row)
    accepts = np.array([sum(1 << ends[s] for s in states if s in ends) for states in todo], np.int64)
    return _minimal(np.array(rows), accepts)


def _minimal(step: np.ndarray, accepts: np.ndarray) -> Automaton:
    """Refine the partition by accepted rules until it is stable under every byte."""
    group = np.unique(accepts, return_inverse=True)[1].ravel()
    columns = np.unique(step, axis=1)  # bytes of one class have equal columns
    while True:
        finer = np.unique(np.column_stack([group, group[columns]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    one_of = np.unique(group, return_index=True)[1]
    # the start first, accepting groups last
    order = sorted(range(len(one_of)), key=lambda g: (accepts[one_of[g]] != 0, g != group[0], g))
    place = np.argsort(order)
    taken = one_of[order]
    accepts = accepts[taken]
    return Automaton(place[group[step[taken]]], accepts, int((accepts == 0).sum()))

"""Exact interpolated quantiles of whole columns, one way for every size.

Each wanted order statistic is bracketed with a mergeable sketch, the bracket is verified with exact counts,
and this repeats until the rows inside are few enough to list.  One job takes the counts, the extremes and the first
sketch of all columns; a column that is small by then goes straight to the listing.

NaN is missing, as null is.  Infinities are values: a quantile that lies between a finite value and an
infinite one is that infinity, and one between both infinities is NaN.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from torqueline.functions import sql

LISTED_ROWS = 20_000
SKETCH_ACCURACY = 10_000


def quantile_exprs(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[tuple[str, float], str]:
    """SQL aggregates for a coming job, one per (column, quantile): constants computed here."""
    return {k: f"first({sql.number(v)})" for k, v in exact_quantiles(df, wanted).items()}


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return {c: v for (c, _), v in exact_quantiles(df, {c: [0.5] for c in cols}).items()}


def exact_quantiles(
    df: DataFrame, wanted: Mapping[str, Sequence[float]], listed_rows: int = LISTED_ROWS,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[tuple[str, float], float | None]:
    """Quantiles by repeated bracketing; never holds more than ``listed_rows`` rows per rank."""
    if not wanted:
        return {}
    # once per row, however often the jobs below name the column
    df = df.selectExpr(*[f"nullif(CAST({sql.name(c)} AS DOUBLE), CAST('NaN' AS DOUBLE)) AS {sql.name(c)}" for c in wanted])
    parts = []
    for c, qs in wanted.items():
        x, at = sql.name(c), ", ".join(sql.number(s) for q in qs for s in _around(q, accuracy))
        parts.append(f"struct(count({x}), min({x}), max({x}), percentile_approx({x}, array({at}), {accuracy})) AS s{len(parts)}")
    row = df.selectExpr(*parts).first()
    size = {c: row[i][0] for i, c in enumerate(wanted)}
    # one bracket [lo, hi] per (column, rank): rows below it, rows inside it
    brackets, sketched = {}, {}
    for i, (c, qs) in enumerate(wanted.items()):
        for j, q in enumerate(qs if size[c] else []):
            place = q * (size[c] - 1)
            for rank in {math.floor(place), math.ceil(place)}:
                brackets[c, rank] = (row[i][1], row[i][2], 0, size[c])
                sketched[c, rank] = tuple(row[i][3][2 * j:2 * j + 2])
    done: dict[tuple[str, int], float] = {}
    while True:
        for key, (lo, hi, _, _) in list(brackets.items()):
            if lo == hi:
                done[key] = lo
                del brackets[key]
        wide = {k: b for k, b in brackets.items() if b[3] > listed_rows}
        if not wide:
            break
        ends = {k: sketched[k] for k in wide} if sketched else _sketch(df, wide, accuracy)
        sketched = {}
        brackets |= _counted(df, wide, ends)
    done |= _listed(df, brackets)
    out: dict[tuple[str, float], float | None] = {}
    for c, qs in wanted.items():
        for q in qs:
            place = q * (size[c] - 1)
            out[c, q] = _between(
                done[c, math.floor(place)], done[c, math.ceil(place)], place - math.floor(place)) if size[c] else None
    return out


def _between(low: float, high: float, share: float) -> float:
    if low == high or not share:
        return low
    if math.isinf(low) != math.isinf(high):
        return low if math.isinf(low) else high
    return low + (high - low) * share


def _around(share: float, accuracy: int) -> tuple[float, float]:
    return tuple(min(max(share + d / accuracy, 0.0), 1.0) for d in (-2.0, 2.0))


def _inside(c: str, lo: float, hi: float) -> str:
    return f"({sql.name(c)} BETWEEN {sql.number(lo)} AND {sql.number(hi)})"


def _sketch(df: DataFrame, wide: dict, accuracy: int) -> dict:
    """New ends around each rank, from a sketch of the rows inside its bracket."""
    keys = list(wide)
    shares: dict[tuple, list[float]] = {}
    for c, rank in keys:
        lo, hi, below, inside = wide[c, rank]
        shares.setdefault((c, lo, hi), []).extend(_around((rank - below) / max(inside - 1, 1), accuracy))
    row = df.selectExpr(*[
        f"percentile_approx({sql.name(c)}, array({', '.join(map(sql.number, at))}), {accuracy}) "
        f"FILTER (WHERE {_inside(c, lo, hi)}) AS p{i}"
        for i, ((c, lo, hi), at) in enumerate(shares.items())
    ]).first()
    found = {bracket: iter(row[i]) for i, bracket in enumerate(shares)}
    ends = {}
    for c, rank in keys:
        values = found[c, wide[c, rank][0], wide[c, rank][1]]
        ends[c, rank] = (next(values), next(values))
    return ends


def _counted(df: DataFrame, wide: dict, ends: dict) -> dict:
    """The bracket of each rank that exact counts around the new ends leave; it holds fewer rows than before."""
    # ranks next to each other mostly share their new bracket: count each one once
    cells = list(dict.fromkeys((c, *ends[c, rank]) for c, rank in wide))
    counted = df.selectExpr(*[
        f"struct(count_if({x} < {sql.number(a)}), count_if({_inside(c, a, b)}), "
        f"max(IF({x} < {sql.number(a)}, {x}, NULL)), min(IF({x} > {sql.number(b)}, {x}, NULL))) AS n{i}"
        for i, (c, a, b) in enumerate(cells) for x in [sql.name(c)]
    ]).first()
    counts = {cell: counted[i] for i, cell in enumerate(cells)}
    out = {}
    for c, rank in wide:
        lo, hi, below, inside = wide[c, rank]
        under, within, next_below, next_above = counts[c, *ends[c, rank]]
        if rank < under:
            out[c, rank] = (lo, next_below, below, under - below)
        elif rank < under + within:
            out[c, rank] = (*ends[c, rank], under, within)
            if within == inside and lo < hi:
                # the sketch could not cut the bracket: halve the value range instead
                out[c, rank] = _halved(df, c, rank, out[c, rank])
        else:
            out[c, rank] = (next_above, hi, under + within, below + inside - under - within)
    return out


def _halved(df: DataFrame, c: str, rank: int, bracket: tuple) -> tuple:
    lo, hi, below, inside = bracket
    largest = sys.float_info.max
    middle = max(lo, -largest) / 2 + min(hi, largest) / 2
    if not lo <= middle < hi:  # no value between, or the lower end is minus infinity
        middle = lo
    x = sql.name(c)
    left = _inside(c, lo, middle)
    right = f"{x} > {sql.number(middle)} AND {x} <= {sql.number(hi)}"
    n, top, bottom = df.selectExpr(
        f"count_if({left})", f"max(IF({left}, {x}, NULL))", f"min(IF({right}, {x}, NULL))"
    ).first()
    return (lo, top, below, n) if rank < below + n else (bottom, hi, below + n, inside - n)


def _listed(df: DataFrame, brackets: dict) -> dict:
    """Order statistics read off the value counts inside each (by now narrow) bracket."""
    if not brackets:
        return {}
    cells = list(dict.fromkeys((c, b[0], b[1]) for (c, _), b in brackets.items()))
    hits = ", ".join(
        f"IF({_inside(*cell)}, struct({i} AS i, {sql.name(cell[0])} AS v), NULL)" for i, cell in enumerate(cells)
    )
    rows = (
        df.filter(" OR ".join(_inside(*cell) for cell in cells))
        .selectExpr(f"inline(array_compact(array({hits})))").groupBy("i", "v").count().collect()
    )
    values: dict[int, list] = {}
    for r in rows:
        values.setdefault(r["i"], []).append((r["v"], r["count"]))
    out = {}
    for key, (lo, hi, below, _) in brackets.items():
        seen = below
        for v, n in sorted(values[cells.index((key[0], lo, hi))]):
            seen += n
            if key[1] < seen:
                out[key] = v
                break
    return out

"""Chained linear-regression imputation, M16.

What a gap is filled with is an affine function of the row's present values that depends only on which values are
missing.  So one scan groups the rows by their pattern of gaps and sums the products of the present
values per pattern; every regression of every round follows from these sums on the driver, which holds a matrix of
(p + 1) x (p + 1) per pattern that occurs, and one narrow pass applies the result.  Rounds end when the
filled values of a round have moved by less than the tolerance in the root mean square.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torqueline.functions import sql
from torqueline.sources.sinks import read_json, write_json

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


@dataclass(frozen=True)
class Step:
    column: int
    weights: tuple[float, ...]
    intercept: float


@dataclass(frozen=True)
class ImputerModel:
    cols: tuple[str, ...]
    start: tuple[float, ...]
    steps: tuple[Step, ...]

    def save(self, spark: SparkSession, path: str) -> None:
        write_json(spark, path, {"cols": self.cols, "start": self.start, "steps": [[s.column, s.weights, s.intercept] for s in self.steps]})

    @staticmethod
    def load(spark: SparkSession, path: str) -> ImputerModel:
        m = read_json(spark, path)
        return ImputerModel(tuple(m["cols"]), tuple(m["start"]), tuple(Step(c, tuple(w), b) for c, w, b in m["steps"]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Replay the fitted steps; each row depends on itself only."""
        names, start, steps = list(self.cols), np.array(self.start), self.steps
        kind = T.StructType([T.StructField(c, T.DoubleType()) for c in names])
        any_gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])

        @F.pandas_udf(kind)
        def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                todo = frame["__gap"].to_numpy(dtype=bool)
                whole = frame[names].to_numpy(dtype=float, na_value=np.nan)
                x = whole[todo]
                gap = np.isnan(x)
                x = np.where(gap, start, x)
                for s in steps:
                    hole = gap[:, s.column]
                    x[hole, s.column] = x[hole] @ np.array(s.weights) + s.intercept
                whole[todo] = x
                yield pd.DataFrame(whole, columns=names)

        row = F.struct(any_gap.alias("__gap"), *[F.col(c).cast("double").alias(c) for c in names])
        out = df.withColumn("__out", filled(row))
        return out.withColumns({c: F.col("__out")[c] for c in names}).drop("__out")


class IterativeImputer:
    """Regress each column on the others in turn, fewest gaps first, starting from means."""

    def __init__(self, cols: Sequence[str], rounds: int = 10, tol: float = 1e-3):
        self.cols, self.rounds, self.tol = list(cols), rounds, tol

    def fit(self, df: DataFrame) -> ImputerModel:
        p = len(self.cols)
        data = df.select(*[F.col(c).cast("double").alias(f"o{i}") for i, c in enumerate(self.cols)])
        row = data.agg(*[F.avg(f"o{i}") for i in range(p)], *[F.max(F.abs(f"o{i}")) for i in range(p)]).first()
        start = [v if v is not None else 0.0 for v in row[:p]]
        limit = self.tol * max([v for v in row[p:] if v is not None], default=0.0)
        sums = self._pattern_sums(data, start)
        gaps = [sum(g[0, 0] for m, g in sums.items() if m >> i & 1) for i in range(p)]
        order = [i for i in sorted(range(p), key=lambda i: gaps[i]) if gaps[i]]
        # per pattern: (1, all values less their start) from (1, present values less their start)
        fill = {m: np.diag([1.0] + [0.0 if m >> i & 1 else 1.0 for i in range(p)]) for m in sums}
        steps: list[Step] = []
        for _ in range(self.rounds if order else 0):
            before = {m: t.copy() for m, t in fill.items()}
            for j in order:
                known = [fill[m] @ g @ fill[m].T for m, g in sums.items() if not m >> j & 1]
                gram = sum(known) if known else np.zeros((p + 1, p + 1))
                step = _solve(gram, start, j) if gram[0, 0] else Step(j, (0.0,) * p, start[j])
                steps.append(step)
                w = np.array(step.weights)
                shift = np.concatenate([[step.intercept + w @ np.array(start) - start[j]], w])
                for m, t in fill.items():
                    if m >> j & 1:
                        t[j + 1] = shift @ t
            moved = sum(np.trace((fill[m] - before[m]) @ g @ (fill[m] - before[m]).T) for m, g in sums.items())
            if np.sqrt(max(moved, 0.0) / sum(gaps)) < limit:
                break
        return ImputerModel(tuple(self.cols), tuple(start), tuple(steps))

    def _pattern_sums(self, data: DataFrame, centre: Sequence[float]) -> dict[int, np.ndarray]:
        """Sums of products of (1, x - centre), absent values as 0, per bit pattern of gaps; one scan."""
        p = len(self.cols)
        bits = " + ".join(f"IF(o{i} IS NULL, shiftleft(1L, {i}), 0L)" for i in range(p))
        values = data.selectExpr(f"{bits} AS m", *[f"coalesce(o{i} - {sql.number(c)}, 0D) AS x{i}" for i, c in enumerate(centre)])
        v = ["1.0D"] + [f"x{i}" for i in range(p)]
        cells = [(a, b) for a in range(p + 1) for b in range(a, p + 1)]
        rows = values.groupBy("m").agg(*[F.expr(f"sum({v[a]} * {v[b]})") for a, b in cells]).collect()
        out = {}
        for row in rows:
            gram = np.zeros((p + 1, p + 1))
            for value, (a, b) in zip(row[1:], cells, strict=True):
                gram[a, b] = gram[b, a] = value
            out[row[0]] = gram
        return out


def _solve(gram: np.ndarray, centre: Sequence[float], target: int) -> Step:
    """Least squares with intercept from centred sums, least-norm if columns are dependent."""
    p = len(centre)
    others = [i for i in range(p) if i != target]
    n = gram[0, 0]
    idx = np.array(others) + 1
    mean_x = gram[0, idx] / n
    mean_y = gram[0, target + 1] / n
    sxx = gram[np.ix_(idx, idx)] - n * np.outer(mean_x, mean_x)
    sxy = gram[idx, target + 1] - n * mean_x * mean_y
    beta = np.linalg.pinv(sxx, rcond=1e-12, hermitian=True) @ sxy
    weights = np.zeros(p)
    weights[others] = beta
    intercept = centre[target] + mean_y - beta @ (mean_x + np.array(centre)[others])
    return Step(target, tuple(float(w) for w in weights), float(intercept))

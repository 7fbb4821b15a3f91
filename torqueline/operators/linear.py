"""Logistic regression, principal components, k-means and silhouette from sums over the rows (M4, M10-M13).

Every step is one scan that sums in numpy per task; a shuffle by cell adds the tasks' sums, so the driver sees numbers
of features and clusters, never of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torqueline.operators.rows import row_hash, sample_rows
from torqueline.sources.sinks import read_json, write_json

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


def doubles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])


def summed(rows: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``of(matrix)``, which returns ``size`` sums for a matrix of rows; NaN stands for null."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            total += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["cell", "v"])

    found = rows.mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[found.column("cell").to_numpy()] = found.column("v").to_numpy()
    return out


@dataclass(frozen=True)
class LogisticModel:
    cols: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``rawPrediction``, the probability of class 1, and ``prediction``."""
        terms = [F.col(f"`{c}`").cast("double") * F.lit(w) for c, w in zip(self.cols, self.weights, strict=True)]
        z = reduce(lambda a, b: a + b, terms, F.lit(self.intercept))
        df = df.withColumn("rawPrediction", 1 / (1 + F.exp(-z)))
        return df.withColumn("prediction", (F.col("rawPrediction") > 0.5).cast("double"))

    def save(self, spark: SparkSession, path: str) -> None:
        write_json(spark, path, {"cols": self.cols, "weights": self.weights, "intercept": self.intercept})

    @staticmethod
    def load(spark: SparkSession, path: str) -> LogisticModel:
        m = read_json(spark, path)
        return LogisticModel(tuple(m["cols"]), tuple(m["weights"]), m["intercept"])


def fit_logistic(df: DataFrame, cols: Sequence[str], label: str, penalty: float = 1.0, iterations: int = 100, tol: float = 1e-9) -> LogisticModel:
    """Newton steps on the summed log loss plus ``penalty / 2`` times the squared weights; the intercept is free.

    Rows with a missing feature or label are left out.  A step is halved while it does not lower the loss.
    """
    rows = doubles(df, [*cols, label]).dropna().persist()
    d = len(cols)
    try:
        moments = summed(rows, 2 * d + 1, lambda x: np.concatenate([[len(x)], x[:, :d].sum(axis=0), (x[:, :d] ** 2).sum(axis=0)]))
        n = moments[0]
        if not n:
            raise ValueError("no complete row")
        # steps are taken on scaled features, which the penalty undoes
        mean = moments[1:d + 1] / n
        scale = np.sqrt(np.maximum(moments[d + 1:] / n - mean**2, 0))
        scale = np.where(scale > 0, scale, 1.0)
        ridge = np.append(penalty / scale**2, 0.0)

        def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            def of(x: np.ndarray) -> np.ndarray:
                z = np.column_stack([(x[:, :d] - mean) / scale, np.ones(len(x))])
                u, y = z @ beta, x[:, d]
                p = 1 / (1 + np.exp(-u))
                loss = (np.logaddexp(0, u) - y * u).sum()
                return np.concatenate([[loss], z.T @ (p - y), (z.T @ (z * (p * (1 - p))[:, None])).ravel()])

            s = summed(rows, 1 + (d + 1) + (d + 1) ** 2, of)
            return s[0] + (ridge * beta**2).sum() / 2, s[1:d + 2] + ridge * beta, s[d + 2:].reshape(d + 1, d + 1) + np.diag(ridge)

        beta = np.zeros(d + 1)
        loss, slope, bend = at(beta)
        for _ in range(iterations):
            if np.abs(slope).max() <= tol * n:
                break
            step = np.linalg.lstsq(bend, slope, rcond=None)[0]
            for _ in range(30):
                found = at(beta - step)
                if found[0] <= loss * (1 + 1e-12):
                    break
                step = step / 2
            beta = beta - step
            loss, slope, bend = found
        weights = beta[:d] / scale
        return LogisticModel(tuple(cols), tuple(map(float, weights)), float(beta[d] - (weights * mean).sum()))
    finally:
        rows.unpersist()


def moment_matrix(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows without gaps, their means and population covariances, in one scan."""
    d = len(cols)
    rows = doubles(df, cols).dropna()
    # differences to any row near the middle keep the products small
    some = rows.first()
    shift = np.array(some, float) if some else np.zeros(d)

    def of(x: np.ndarray) -> np.ndarray:
        z = x - shift
        return np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])

    s = summed(rows, 1 + d + d * d, of)
    n, mean = int(s[0]), s[1:d + 1] / max(s[0], 1)
    return n, mean + shift, s[d + 1:].reshape(d, d) / max(n, 1) - np.outer(mean, mean)


def principal_components(df: DataFrame, cols: Sequence[str], k: int, scaled: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, loadings): the largest loading of a component is positive."""
    _, mean, cov = moment_matrix(df, cols)
    scale = np.sqrt(np.maximum(np.diag(cov), 0)) if scaled else np.ones(len(cols))
    scale = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    loadings = vectors[:, np.argsort(-values, kind="stable")[:k]]
    largest = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    return mean, scale, loadings * np.where(largest < 0, -1.0, 1.0)


# ---- clusters


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)


def starting_centres(rows: DataFrame, k: int, seed: int, most: int = 4096) -> np.ndarray:
    """k-means++ over at most ``most`` rows chosen by their hash, with draws that follow from ``seed``."""
    drawn = sample_rows(rows, most, rows.columns, draw=row_hash(rows.columns, seed)).toArrow()
    x = np.column_stack([c.to_numpy() for c in drawn.columns]).astype(float)
    x = x[np.lexsort(x.T[::-1])]
    if not len(x):
        raise ValueError("no complete row")
    rng = np.random.default_rng(seed)
    centres = [x[rng.integers(len(x))]]
    while len(centres) < k:
        far = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2).min(axis=1)
        centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else centres[0])
    return np.array(centres)


def fit_kmeans(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42, rounds: int = 100, tol: float = 1e-4,
               start: Sequence[Sequence[float]] | None = None) -> np.ndarray:
    """Centres after Lloyd steps, in ascending order; an empty cluster keeps its centre."""
    d = len(cols)
    rows = doubles(df, cols).dropna().persist()
    try:
        centres = np.array(start, float) if start is not None else starting_centres(rows, k, seed)
        for _ in range(rounds):
            def of(x: np.ndarray, centres=centres) -> np.ndarray:
                at = _nearest(x, centres)
                return np.column_stack([np.bincount(at, minlength=k)] + [np.bincount(at, x[:, j], k) for j in range(d)]).ravel()

            s = summed(rows, k * (d + 1), of).reshape(k, d + 1)
            moved = np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1), centres)
            still = np.abs(moved - centres).max() <= tol
            centres = moved
            if still:
                break
        return centres[np.lexsort(centres.T[::-1])]
    finally:
        rows.unpersist()


def distances(cols: Sequence[str], centres: np.ndarray) -> list[Column]:
    """Squared distance to each centre."""
    return [reduce(lambda a, b: a + b, [F.pow(F.col(f"`{c}`").cast("double") - F.lit(float(v)), F.lit(2)) for c, v in zip(cols, row, strict=True)])
            for row in centres]


def with_cluster(df: DataFrame, cols: Sequence[str], centres: np.ndarray, out: str) -> DataFrame:
    """Number of the nearest centre, the first of equals; null for rows with a missing value."""
    d = F.array(*distances(cols, centres))
    complete = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cols])
    return df.withColumn(out, F.when(complete, (F.array_position(d, F.array_min(d)) - 1).cast("int")))


def silhouette(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """One row: the mean silhouette with squared Euclidean distance, exact and linear in the rows.

    A row's mean squared distance to a cluster follows from the cluster's rows, sum and sum of squares, so one aggregate
    per cluster and one narrow pass do.  A row alone in its cluster counts 0, as does everything if there is one cluster.
    """
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    square = reduce(lambda a, b: a + b, [v * v for v in x])
    complete = df.where(F.col(cluster).isNotNull() & square.isNotNull())
    sums = complete.groupBy(F.col(cluster).alias("c")).agg(
        F.count("*").alias("n"), F.sum(square).alias("q"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]).orderBy("c").collect()
    to, own = [], [F.col(cluster) == F.lit(r["c"]) for r in sums]
    for r in sums:
        dot = reduce(lambda a, b: a + b, [v * F.lit(r[f"s{i}"]) for i, v in enumerate(x)])
        to.append(F.greatest(square * r["n"] + F.lit(r["q"]) - 2 * dot, F.lit(0.0)))  # sum of squared distances

    def pick(values: list[Column]) -> Column:
        return F.coalesce(*[F.when(o, v) for o, v in zip(own, values, strict=True)])

    inside = pick([t / (r["n"] - 1) if r["n"] > 1 else F.lit(None).cast("double") for t, r in zip(to, sums, strict=True)]) if sums else F.lit(None)
    others = [F.when(~o, t / r["n"]) for o, t, r in zip(own, to, sums, strict=True)]
    outside = F.least(*others) if len(others) > 1 else F.lit(None).cast("double")
    score = F.coalesce((outside - inside) / F.greatest(outside, inside), F.lit(0.0))
    return complete.agg(F.count("*").alias("rows"), F.avg(score).alias("silhouette"))

"""Kernel outlier flag, M21.

A one-class support vector machine needs a quadratic solver on one machine.  Its limit
for nu -> 1 scores a row by the mean kernel value to all rows (Schölkopf et al. 2001),
and random Fourier features (Rahimi, Recht 2007) turn that mean into a fixed-length
average.  The lowest nu share of scores is flagged.  This is an estimate of the same
density level set, not the machine's optimum.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torqueline.operators.quantiles import exact_quantiles
from torqueline.session import settle, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


def _draw(width: int, gamma: float, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(scale=np.sqrt(2 * gamma), size=(width, features)), rng.uniform(0, 2 * np.pi, size=features)


def _vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols])


def mean_wave(train: DataFrame, cols: Sequence[str], gamma: float, features: int, seed: int) -> np.ndarray:
    """Mean feature vector of the training rows; each task sends one sum per batch."""
    w, b = _draw(len(cols), gamma, features, seed)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            z = np.cos(frame.to_numpy(dtype=float) @ w + b)
            yield pd.DataFrame({"i": np.arange(features), "s": z.sum(axis=0), "n": len(frame)})

    parts = _vectors(train, cols).mapInPandas(sums, "i int, s double, n long")
    rows = parts.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).collect()
    out = np.zeros(features)
    for r in rows:
        out[r["i"]] = r["m"]
    return out


def rbf_score(df: DataFrame, mean: np.ndarray, cols: Sequence[str], gamma: float = 0.01, seed: int = 42,
              out: str = "rbf_score") -> DataFrame:
    """Approximate mean kernel value between each row and the training rows."""
    w, b = _draw(len(cols), gamma, len(mean), seed)
    weight = 2.0 * mean / len(mean)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            yield pd.Series(np.cos(frame.to_numpy(dtype=float) @ w + b) @ weight)

    return df.withColumn(out, score(F.struct(*[F.col(c).cast("double").alias(c) for c in cols])))


def rbf_outlier_flag(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None, nu: float = 0.01,
                     gamma: float = 0.01, features: int = 64, seed: int = 42, out: str = "outlier") -> DataFrame:
    """-1 for the ``nu`` share of rows in the thinnest region, 1 for the rest."""
    train = df if train is None else train
    mean = mean_wave(spread(_vectors(train, cols)), cols, gamma, features, seed)
    known = settle(rbf_score(spread(train), mean, cols, gamma, seed), "scores")
    limit = exact_quantiles(known, {"rbf_score": [nu]})["rbf_score", nu]
    scored = known if df is train else rbf_score(df, mean, cols, gamma, seed)
    return scored.withColumn(out, F.when(F.col("rbf_score") < limit, F.lit(-1)).otherwise(F.lit(1)))

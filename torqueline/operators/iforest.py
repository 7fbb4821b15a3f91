"""Isolation forest, M8 and M9 (Liu, Ting, Zhou 2008).

Each tree needs only a small random sample, so one hash-ordered pick of
``trees * sample`` rows feeds all of them, each tree taking a run of hash ranks that wraps around: the work
on the full table is that pick and the scoring, both narrow.  Trees grow in parallel, one group of at most
``sample`` rows each; the finished forest has a size fixed by the parameters, whatever the table.  The draws of
a node follow from the MD5 of seed, tree and node, so any engine can grow the same forest.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from torqueline.functions.numeric import clip, scaled_between
from torqueline.operators.columns import column_extremes
from torqueline.operators.quantiles import exact_quantiles
from torqueline.operators.rows import row_hash, sample_rows
from torqueline.operators.scaling import standardise
from torqueline.session import settle
from torqueline.sources.sinks import read_json, write_json

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

NODES = "tree int, node int, feature int, cut double, size int"


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    long = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def draw(seed: int, tree: int, node: int, what: str) -> float:
    """A number in [0, 1)."""
    return int(md5(f"{seed}:{tree}:{node}:{what}".encode()).hexdigest()[:15], 16) / 2**60


def _grow(rows: np.ndarray, depth: int, seed: int, tree: int) -> list[tuple[int, int, float, int]]:
    """Nodes (number, feature or -1, cut, size) of one tree; children of i are 2i+1 and 2i+2."""
    nodes, todo = [], [(0, rows, 0)]
    while todo:
        number, part, level = todo.pop()
        lo, hi = (part.min(axis=0), part.max(axis=0)) if len(part) else (0.0, 0.0)
        open_features = np.flatnonzero(hi > lo) if len(part) > 1 and level < depth else []
        if not len(open_features):
            nodes.append((number, -1, 0.0, len(part)))
            continue
        f = int(open_features[int(draw(seed, tree, number, "f") * len(open_features))])
        cut = float(lo[f] + draw(seed, tree, number, "c") * (hi[f] - lo[f]))
        left = part[:, f] <= cut
        nodes.append((number, f, cut, len(part)))
        todo += [(2 * number + 1, part[left], level + 1), (2 * number + 2, part[~left], level + 1)]
    return nodes


@dataclass(frozen=True)
class ForestModel:
    cols: tuple[str, ...]
    trees: int
    depth: int
    sample: int
    feature: np.ndarray
    cut: np.ndarray
    size: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        parts = {"cols": self.cols, "trees": self.trees, "depth": self.depth, "sample": self.sample}
        write_json(spark, path, parts | {k: getattr(self, k).tolist() for k in ("feature", "cut", "size")})

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        m = read_json(spark, path)
        arrays = [np.array(m["feature"], np.int64), np.array(m["cut"], float), np.array(m["size"], np.int64)]
        return ForestModel(tuple(m["cols"]), m["trees"], m["depth"], m["sample"], *arrays)

    def score(self, df: DataFrame, out: str = "AnomalyScore") -> DataFrame:
        """Add the anomaly score in (0, 1], higher for rows that are easier to isolate."""
        names = list(self.cols)
        forest = df.sparkSession.sparkContext.broadcast((self.feature, self.cut, average_path(self.size)))
        norm = float(average_path(self.sample)) or 1.0

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            feature, cut, rest = forest.value
            for frame in batches:
                x = np.ascontiguousarray(frame.to_numpy(dtype=float).T)
                total = np.zeros(x.shape[1])
                for t in range(len(feature)):
                    parts = [(0, 0, np.arange(x.shape[1]))]
                    while parts:
                        node, level, rows = parts.pop()
                        f = feature[t, node]
                        if f < 0:
                            total[rows] += level + rest[t, node]
                        elif len(rows):
                            right = x[f, rows] > cut[t, node]
                            parts += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
                yield pd.Series(np.exp2(-total / len(feature) / norm))

        return df.withColumn(out, score(F.struct(*[F.col(c).cast("double").alias(c) for c in names])))

    def flag(self, df: DataFrame, train: DataFrame, contamination: float = 0.1, out: str = "anomaly", parts: int | None = None) -> DataFrame:
        """-1 for rows scoring above the training quantile, 1 for the rest; ``parts`` deals rows anew before scoring."""
        known = settle(self.score(train.repartition(parts) if parts else train, "__s"), "scores")
        limit = exact_quantiles(known, {"__s": [1 - contamination]})["__s", 1 - contamination]
        scored = known if df is train else self.score(df, "__s")
        return scored.withColumn(out, F.when(F.col("__s") > limit, F.lit(-1)).otherwise(F.lit(1))).drop("__s")


class IsolationForest:
    def __init__(self, cols: Sequence[str], key: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42):
        self.cols, self.key = list(cols), list(key)
        self.trees, self.sample, self.seed = trees, sample, seed

    def fit(self, df: DataFrame) -> ForestModel:
        cols, seed = self.cols, self.seed
        values = [F.col(c).cast("double").alias(c) for c in cols]
        keyed = df.select(*values, *[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.key)])
        names = [f"__k{i}" for i in range(len(self.key))]
        draw = row_hash(names, seed)
        pool = sample_rows(keyed, self.trees * self.sample, names, draw=draw).withColumn("__h", draw).persist()
        rows = pool.count()
        size = min(self.sample, rows)
        depth = math.ceil(math.log2(max(size, 2)))
        # one task ranks the pool, whose size the parameters fix
        ranked = pool.withColumn("rank", F.row_number().over(Window.orderBy("__h", *names)) - 1)
        if rows >= self.trees * size:
            tree = F.floor(F.col("rank") / size)
            picked = ranked.where(tree < self.trees).withColumn("tree", tree.cast("int"))
        else:
            takes = F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.pmod(F.col("rank") - t * size, F.lit(rows)) < size)
            picked = ranked.withColumn("tree", F.explode(takes))

        def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            nodes = _grow(frame[cols].to_numpy(dtype=float), depth, seed, int(key[0]))
            out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "size"])
            out.insert(0, "tree", int(key[0]))
            return out

        grown = picked.select("tree", *cols).groupBy("tree").applyInPandas(grow, NODES).toPandas()
        pool.unpersist()
        width = 2 ** (depth + 1) - 1
        feature = np.full((self.trees, width), -1, dtype=np.int64)
        cut = np.zeros((self.trees, width))
        leaf = np.zeros((self.trees, width), dtype=np.int64)
        t, n = grown["tree"].to_numpy(), grown["node"].to_numpy()
        feature[t, n], cut[t, n], leaf[t, n] = grown["feature"], grown["cut"], grown["size"]
        return ForestModel(tuple(cols), self.trees, depth, size, feature, cut, leaf)


def isolation_forest_score(df: DataFrame, cols: Sequence[str], key: Sequence[str], trees: int = 200,
                           out: str = "MaintenanceNeed_IF", seed: int = 42, parts: int | None = None) -> DataFrame:
    """Standardise, fit, score, and spread the score over 0-100 (two places, half to even).

    ``parts`` deals the rows anew before they are scored: for tables in too few files.
    """
    temporary = [f"__z_{c}" for c in cols]
    z = standardise(df.withColumns({t: F.col(c).cast("double") for t, c in zip(temporary, cols)}), temporary)
    # scoring costs far more than a write and a read, and its range is needed first
    scored = settle(IsolationForest(temporary, key, trees, seed=seed).fit(z).score(z.repartition(parts) if parts else z, "__score"), "scores")
    _, lo, hi = column_extremes(scored, ["__score"])["__score"]
    need = clip(F.bround(scaled_between("__score", lo, hi) * F.lit(100.0), 2), 0, 100)
    return scored.withColumn(out, need).withColumnRenamed("__score", "AnomalyScore").drop(*temporary)

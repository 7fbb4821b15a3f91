"""Gradient-boosted trees: logistic loss, second-order splits on binned features.

``fit_boosted`` takes arrays, ``fit_boosted_rows`` a table of any size: equal rows are counted, cut points are quantiles of
all of them, and a job per level sums gradients and Hessians per node, feature and bin.  What comes back is bounded by
nodes, features and bins, never by rows.  Gradients are rounded to integers first, so partitions do not matter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from torqueline.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = 1 << 20  # of rounded gradients
DRIVER_CELLS = 1 << 20  # histogram cells of all tasks together that the driver adds up itself
STEPS = 512  # score cells in a unit of log-odds
FARTHEST = 64  # log-odds beyond which score cells are not told apart


@dataclass(frozen=True)
class Boosted:
    """Complete trees of one depth: a split per inner node (feature, value), a weight per leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    prior: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 per row."""
        z, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-z))


def fit_boosted(
    x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, bins: int = 32,
) -> Boosted:
    """Fit on rows ``x`` and classes ``y`` in 0, 1; the same rows in the same order give the same trees."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins), method="lower")) for f in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    rate_of_one = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    prior = float(np.log(rate_of_one / (1 - rate_of_one)))
    z = np.full(n, prior)
    inner, out = 2**depth - 1, ([], [], [])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            sums = [_sums(binned, node - first, w, many, bins) for w in (g, h)]
            best, at, _ = _best_splits(*sums, cuts, ridge)
            for k in np.flatnonzero(at >= 0):
                feature[first + k], cut[first + k] = best[k], cuts[best[k]][at[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        leaf = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        z += leaf[at]
        for kept, new in zip(out, (feature, cut, leaf), strict=True):
            kept.append(new)
    return Boosted(*(np.array(kept) for kept in out), prior)


def _sums(binned: np.ndarray, node: np.ndarray, w: np.ndarray, many: int, bins: int) -> np.ndarray:
    """Sums of ``w`` by node, feature and bin."""
    at = node * (bins + 1)
    return np.stack([np.bincount(at + binned[:, f], w, many * (bins + 1)).reshape(many, -1) for f in range(binned.shape[1])], axis=1)


def _best_splits(g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node: feature, cut (-1: no split, all rows go left), and the sums (g, h) of its left and right side."""
    many = len(g)
    best, feature, cut = np.full(many, 1e-9), np.zeros(many, np.int64), np.full(many, -1)
    sides = np.zeros((many, 2, 2))
    sides[:, 0, 0], sides[:, 0, 1] = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
    for f, c in enumerate(cuts):
        gl, hl = g[:, f].cumsum(axis=1), h[:, f].cumsum(axis=1)
        gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gl[:, -1:] ** 2 / (hl[:, -1:] + ridge)
        top = gain[:, :len(c)].argmax(axis=1)
        for k in np.flatnonzero(gain[np.arange(many), top] > best):
            best[k], feature[k], cut[k] = gain[k, top[k]], f, top[k]
            sides[k] = [[gl[k, top[k]], hl[k, top[k]]], [gr[k, top[k]], hr[k, top[k]]]]
    return feature, cut, sides


# ---- tables of any size


@dataclass(frozen=True)
class Trees:
    """Trees over bins: a split per inner node (feature, bin), a weight per leaf."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]
    leaf: list[np.ndarray]
    prior: float

    def odds(self, binned: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(binned), self.prior), np.arange(len(binned))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            z += leaf[descended(binned, rows, feature, cut, len(leaf).bit_length() - 1)]
        return z


def descended(binned: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Place of each row among the nodes of a level."""
    node = np.zeros(len(binned), np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
    return node - (2**levels - 1)


def _matrix(batch: pa.RecordBatch, kind: type) -> np.ndarray:
    cells = batch.column("x").to_pylist()
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1)


def value_cuts(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Different quantiles of each feature over all rows; ``rows`` has (x, n), x packed 32-bit floats, n how often."""
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = _matrix(b, np.float32), b.column("n").to_numpy()
            for f in range(width if b.num_rows else 0):
                v, at = np.unique(x[:, f], return_inverse=True)
                many = np.zeros(len(v), np.int64)
                np.add.at(many, at, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), f, np.int32)), pa.array(v.astype(float)), pa.array(many)], names=["f", "v", "n"])

    of = Window.partitionBy("f")
    found = rows.select("x", "n").mapInArrow(values, "f int, v double, n long").groupBy("f", "v").agg(F.sum("n").alias("n"))
    found = found.select("f", "v", "n", F.sum("n").over(of.orderBy("v")).alias("upto"), F.sum("n").over(of).alias("all"))
    # the quantile of share q is the value at place floor(q * (all - 1))
    places = F.array(*[F.floor(F.lit(q) * (F.col("all") - 1)) for q in np.linspace(0, 1, bins).tolist()])
    found = found.where(F.exists(places, lambda p: (p >= F.col("upto") - F.col("n")) & (p < F.col("upto")))).select("f", "v").collect()
    return [np.array(sorted(r.v for r in found if r.f == f)) for f in range(width)]


def binned_rows(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """The rows with a byte per feature for x, equal ones counted together, written."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b, np.float32).astype(float).reshape(b.num_rows, len(cuts))
            codes = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.uint8)
            at = b.schema.get_field_index("x")
            yield b.set_column(at, "x", pa.array([c.tobytes() for c in codes], pa.binary()))

    others = [c for c in rows.columns if c != "n"]
    return settle(rows.mapInArrow(code, rows.schema).groupBy(*others).agg(F.sum("n").alias("n")), "binned")


def fit_boosted_rows(
    train: DataFrame, cuts: list[np.ndarray], zeros: int, ones: int, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0,
    bins: int = 32,
) -> Trees:
    """Fit on all rows of ``train`` (x, y, n) as :func:`binned_rows` gives them; a job per level."""
    width, parts = len(cuts), train.rdd.getNumPartitions()
    train = train.select("x", "y", "n")
    share = float(np.clip(ones / (zeros + ones), 1e-3, 1 - 1e-3))
    trees, inner = Trees([], [], [], float(np.log(share / (1 - share)))), 2**depth - 1
    for _ in range(rounds):
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            g, h = _histograms(train, parts, trees, feature, cut, level, width, bins)
            best, at, sides = _best_splits(g, h, cuts, ridge)
            split = np.flatnonzero(at >= 0)
            feature[first + split], cut[first + split] = best[split], at[split]
        sides = sides.reshape(2 * many, 2)
        for kept, new in zip((trees.feature, trees.cut, trees.leaf), (feature, cut, rate * sides[:, 0] / (sides[:, 1] + ridge)), strict=True):
            kept.append(new)
    return trees


def _histograms(
    train: DataFrame, parts: int, trees: Trees, feature: np.ndarray, cut: np.ndarray, level: int, width: int, bins: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and Hessians by node of the level, feature and bin."""
    many = 2**level
    cells = many * width * (bins + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, cells), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, y, n = _matrix(b, np.uint8), b.column("y").to_numpy(), b.column("n").to_numpy()
            p = 1 / (1 + np.exp(-trees.odds(x)))
            node = descended(x, np.arange(len(x)), feature, cut, level)
            for k, w in enumerate((y - p, p * (1 - p))):
                total[k] += _sums(x, node, np.rint(w * UNIT) * n, many, bins).reshape(-1).astype(np.int64)
        full = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[0, full]), pa.array(total[1, full])], names=["cell", "g", "h"])

    found = train.mapInArrow(sums, "cell long, g long, h long")
    if parts * cells > DRIVER_CELLS:
        found = found.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    found = found.toArrow()
    out = np.zeros((2, cells), np.int64)
    for k, c in enumerate("gh"):
        np.add.at(out[k], found.column("cell").to_numpy(), found.column(c).to_numpy())
    g, h = (out / UNIT).reshape(2, many, width, bins + 1)
    return g, h


def valued(trees: Trees, cuts: list[np.ndarray]) -> Boosted:
    """The same trees over values."""
    feature, at = np.array(trees.feature), np.array(trees.cut)
    cut = np.array([[cuts[f][b] if b < 255 else np.inf for f, b in zip(*row, strict=True)] for row in zip(feature, at, strict=True)])
    return Boosted(feature, cut, np.array(trees.leaf), trees.prior)


def thresholds_of_rows(held: DataFrame, trees: Trees, kinds: int, precision: float) -> tuple[float, ...]:
    """:func:`threshold_for` of each kind over all rows of ``held`` (kind, x, y, n); scores of one cell, 1 / STEPS wide
    in log-odds, count as a tie."""
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = trees.odds(_matrix(b, np.uint8))
                at = np.floor(np.clip(z, -FARTHEST, FARTHEST) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(at), pa.array(z), b.column("y"), b.column("n")], names=["kind", "cell", "z", "y", "n"])

    found = held.select("kind", "x", "y", "n").mapInArrow(cells, "kind int, cell long, z double, y int, n long").groupBy("kind", "cell").agg(
        F.min("z").alias("lo"), F.max("z").alias("hi"), F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("ones")).collect()
    out = []
    for k in range(kinds):
        own = sorted((r for r in found if r.kind == k), key=lambda r: -r.cell)
        share = np.cumsum([r.ones for r in own]) / (np.cumsum([r.n for r in own]) + 1.0)
        good = np.flatnonzero(share >= precision)
        if not len(good):
            out.append(float("inf"))
            continue
        last, below = own[good[-1]].lo, own[good[-1] + 1].hi if good[-1] + 1 < len(own) else -np.inf
        out.append(max(0.5, float(1 / (1 + np.exp(-last)) + 1 / (1 + np.exp(-below))) / 2))
    return tuple(out)


def threshold_for(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Score that parts the rows where the share of class 1, with one error added, still reaches ``precision``.

    Halfway to the next score below, at least even odds; infinity if no share is high enough.
    """
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(y[order]) / (np.arange(len(y)) + 2.0)
    last_of_tie = np.append(score[order][1:] != score[order][:-1], True) if len(y) else np.zeros(0, bool)
    good = np.flatnonzero((share >= precision) & last_of_tie)
    if not len(good):
        return float("inf")
    below = score[order][good[-1] + 1] if good[-1] + 1 < len(y) else 0.0
    return max(0.5, float(score[order][good[-1]] + below) / 2)

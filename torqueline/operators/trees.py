"""Trees from histograms: second-order boosting and forests by hash bootstrap (M2, M3, M5, M17, M18, M20).

The training rows are binned once, at quantiles of a bounded hash sample, and written as packed blocks: one byte per feature, the target
and a hash of the row.  Gradients and Hessians are summed level by level per (tree, node, feature, bin).  Up to ``held.TASKS``
tasks side by side do so in one stage for the whole fit, in which each keeps its rows.  With more, one job per level: tasks sum
their blocks in numpy, the shuffle adds the sums of the tasks, and what comes back is bounded by nodes, features and
bins, never by rows; a row's nodes and its latest margins then follow from its bins anew in each job.

Boosting follows first and second derivatives of the loss with an L2 term on leaf values; a missing value goes to the
side with the higher gain.  A forest grows many trees in the same jobs; a row's weight in a tree is a Poisson draw from
its hash and the tree's number, the features of a node are drawn from the numbers of the tree and the node.  With
gradient -weight * target and Hessian weight the same gain is the drop in variance, for 0/1 targets half that in Gini
impurity.

Gradients are rounded to integers before they are summed, so the sums, and with them the trees, do not depend on how
the rows are partitioned or in which order tasks end.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torqueline.operators import held
from torqueline.operators.rows import row_hash, sample_rows
from torqueline.session import scratch, scratch_path, settle
from torqueline.sources.sinks import read_json, write_json

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

BLOCK = 1 << 13  # rows; a float holds the sums of so many rounded gradients exactly
CELLS = 1 << 21  # histogram cells of a job
DRIVER_CELLS = 1 << 21  # cells of all tasks together that the driver adds up itself, about 50 MB
MISSING = 255  # bin
CUT_ROWS = 100_000  # rows that cut points come from
REFRESH = 10  # rounds after which margins are written
TASK_ROWS = 1 << 16  # rows that are worth a task of their own
U = np.uint64
SUMS = T.StructType([T.StructField(c, T.LongType()) for c in ("cell", "g", "h")])


@dataclass(frozen=True)
class TreeEnsemble:
    """Trees as arrays (tree, node); the children of node i are 2i + 1 and 2i + 2, feature -1 marks a leaf.

    ``link`` turns the sum (boosting) or mean (forest) of the leaf values into the score: "logistic" and "share" give
    the probability of class 1, "value" the value itself.
    """

    cols: tuple[str, ...]
    link: str
    base: float
    mean: bool
    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @property
    def trees(self) -> int:
        return len(self.feature)

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = ("feature", "cut", "missing_left", "value", "gain")
        write_json(spark, path, {"cols": self.cols, "link": self.link, "base": self.base, "mean": self.mean} |
                   {k: getattr(self, k).tolist() for k in arrays})

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeEnsemble:
        m = read_json(spark, path)
        return TreeEnsemble(tuple(m["cols"]), m["link"], m["base"], m["mean"], np.array(m["feature"], np.int64), np.array(m["cut"], float),
                            np.array(m["missing_left"], bool), np.array(m["value"], float), np.array(m["gain"], float))

    def _coded(self) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
        """Cut points of each feature, and the trees over codes: 0 for a missing value, else 1 + the number of points below it.

        ``child`` is the left one; a node that ends a path, or that nothing passes to the right of, has a cut no code exceeds.
        """
        shape, count = self.feature.shape, self.feature.shape[1]
        points, cut = [], np.full(shape, np.iinfo(np.int32).max, np.int32)
        for j in range(len(self.cols)):
            mine = (self.feature == j) & ~np.isposinf(self.cut)
            points.append(np.unique(self.cut[mine]))
            cut[mine] = np.searchsorted(points[j], self.cut[mine]) + 1
        leaf, node = self.feature < 0, np.arange(count)
        return points, {"feature": np.where(leaf, 0, self.feature), "cut": cut, "child": np.where(leaf, node, np.minimum(2 * node + 1, count - 1)),
                        "gone_right": ~leaf & ~self.missing_left, "value": self.value}

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """Add the score, in one narrow pass.

        Values only count by the cut points they lie between, so rows that lie alike are scored once a batch.
        """
        names = list(self.cols)
        coded = df.sparkSession.sparkContext.broadcast(self._coded())
        base, mean, link, trees = self.base, self.mean, self.link, max(self.trees, 1)
        levels = (self.feature.shape[1] + 1).bit_length() - 2

        def codes_of(frame: pd.DataFrame, points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
            """Codes by feature of the rows that differ, and the place of each row among them (none if it is its own)."""
            x = np.empty((len(points), len(frame)), np.int32)
            key, wide = np.zeros(len(frame), np.int64), 1
            for j, p in enumerate(points):
                v = frame.iloc[:, j].to_numpy(dtype=float)
                x[j] = np.where(np.isnan(v), 0, np.searchsorted(p, v, side="left") + 1)
                wide *= len(p) + 2
                key = key * (len(p) + 2) + x[j] if wide < 1 << 62 else key
            if wide >= 1 << 62:
                return x, None
            _, first, place = np.unique(key, return_index=True, return_inverse=True)
            return (x[:, first], place) if len(first) < 0.9 * len(key) else (x, None)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            points, t = coded.value
            for frame in batches:
                x, place = codes_of(frame, points)
                n = x.shape[1]
                gone, flat, rows = bool((x == 0).any()), x.ravel(), np.arange(n)
                total = np.zeros(n)
                for k in range(len(t["value"])):
                    from_, cut, child, gone_right = t["feature"][k] * n, t["cut"][k], t["child"][k], t["gone_right"][k]
                    node = np.zeros(n, np.int64)
                    for _ in range(levels):
                        at = from_.take(node, mode="clip")
                        at += rows
                        code = flat.take(at, mode="clip")
                        right = code > cut.take(node, mode="clip")
                        if gone:
                            right |= (code == 0) & gone_right.take(node, mode="clip")
                        node = child.take(node, mode="clip")
                        node += right
                    total += t["value"][k].take(node, mode="clip")
                total = base + (total / trees if mean else total)
                total = 1 / (1 + np.exp(-total)) if link == "logistic" else total
                yield pd.Series(total if place is None else total[place])

        return df.withColumn(out, score(F.struct(*[F.col(c).cast("double").alias(c) for c in names])))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``; for classes also ``rawPrediction``, the probability of class 1."""
        if self.link == "value":
            return self.score(df, "prediction")
        return self.score(df, "rawPrediction").withColumn("prediction", (F.col("rawPrediction") > 0.5).cast("double"))

    def importances(self) -> np.ndarray:
        """Share of each feature in the gains, per tree for forests, then over the trees."""
        by_tree = np.zeros((self.trees, len(self.cols)))
        for j in range(len(self.cols)):
            by_tree[:, j] = np.where(self.feature == j, self.gain, 0.0).sum(axis=1)
        if self.mean:
            by_tree = by_tree / np.maximum(by_tree.sum(axis=1, keepdims=True), 1e-300)
        total = by_tree.sum(axis=0)
        return total / max(total.sum(), 1e-300)


# ---- rows


def cut_points(rows: DataFrame, width: int, bins: int, most: int = CUT_ROWS) -> list[np.ndarray]:
    """Distinct quantiles of the finite values of each column, over at most ``most`` rows, those with the least ``draw``.

    A value belongs to the bin of the first cut not below it.
    """
    names = [f"x{i}" for i in range(width)]
    drawn = sample_rows(rows.select("draw", *names), most, names, draw=F.col("draw")).select(*names).toArrow()
    shares, out = np.arange(1, bins) / bins, []
    for i in range(width):
        x = drawn.column(i).to_numpy().astype(float)
        x = x[np.isfinite(x)]
        at = np.quantile(x, shares) if len(x) else np.zeros(0)
        out.append(np.unique(at))
    return out


def plain_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]


def prepared(df: DataFrame, cols: Sequence[str], target: str, bins: int, key: Sequence[str], hashed: bool) -> tuple[DataFrame, list[np.ndarray]]:
    """Packed blocks and the cut points of their bins.

    The rows are written first: their hashes take more time than all that is done with them here.
    """
    path = scratch_path(df.sparkSession, "packed")
    with scratch(df.sparkSession):
        rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(target).cast("double").alias("y"),
                         row_hash(key, 42).alias("draw"), *[row_hash(key).alias("hash")] * hashed)
        rows = settle(rows, "rows")
        cuts = cut_points(rows, len(cols), bins)
        return packed(rows, cuts, hashed, path), cuts


def packed(rows: DataFrame, cuts: list[np.ndarray], hashed: bool, path: str) -> DataFrame:
    """(n, bins, y, hash) blocks of at most BLOCK rows; rows without a target are left out."""
    width = len(cuts)
    rows = rows.select(*[f"x{i}" for i in range(width)], "y", *["hash"] * hashed).where("y IS NOT NULL AND NOT isnan(y)")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def block() -> pa.RecordBatch:
            bins = np.concatenate([h[0] for h in waiting], axis=1)
            y, hashes = np.concatenate([h[1] for h in waiting]), np.concatenate([h[2] for h in waiting]) if hashed else np.zeros(0)
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32())] + [
                pa.array([x.tobytes()], pa.binary()) for x in (bins, y, hashes)], names=["n", "bins", "y", "hash"])

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                bins = np.empty((width, part.num_rows), np.uint8)
                for j in range(width):
                    x = part.column(j).to_numpy(zero_copy_only=False).astype(float)
                    bins[j] = np.where(np.isnan(x), MISSING, np.searchsorted(cuts[j], x, side="left"))
                if sum(len(h[1]) for h in waiting) + part.num_rows > BLOCK:
                    yield block()
                waiting.append((bins, *[part.column(width + i).to_numpy(zero_copy_only=False) for i in range(1 + hashed)]))
        if waiting:
            yield block()

    blocks, tasks = rows.mapInArrow(pack, "n int, bins binary, y binary, hash binary"), rows.sparkSession.sparkContext.defaultParallelism
    # a table in few files has few tasks; its blocks are small enough to deal out
    return settle(blocks.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else blocks, "packed", path)


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for n, bins, y, hashes in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
        yield np.frombuffer(bins, np.uint8).reshape(width, n), np.frombuffer(y, float), np.frombuffer(hashes, np.int64)


# ---- growing


def descended(bins: np.ndarray, feature: np.ndarray, cut_bin: np.ndarray, missing_left: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row after ``levels`` steps."""
    node, rows = np.zeros(bins.shape[1], np.int64), np.arange(bins.shape[1])
    for _ in range(levels):
        f = feature[node]
        v = bins[np.maximum(f, 0), rows]
        right = np.where(v == MISSING, ~missing_left[node], v > cut_bin[node])
        node = np.where(f < 0, node, 2 * node + 1 + right)
    return node


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: cumulative Poisson(1) probabilities; more than 12 is rarer than one in ten thousand million
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 13)]))


def bootstrap(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    x = mixed(hashes.astype(U) + U((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return np.searchsorted(POISSON, (x >> U(11)).astype(float) / 2.0**53, side="right")


def chosen_features(tree: int, node: int, width: int, most: int, seed: int) -> np.ndarray:
    if most >= width:
        return np.arange(width)
    draws = mixed(np.arange(width, dtype=U) + U(((seed * 1_000_003 + tree) * 100_003 + node) * 0xD1342543DE82EF95 & (1 << 64) - 1))
    return np.sort(np.argsort(draws, kind="stable")[:most])


def histograms(blocks: DataFrame, parts: int, gradients: Callable, active: list[tuple[int, np.ndarray, np.ndarray]], grown: list[tuple],
               levels: int, width: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and Hessians, shape (active nodes, features of a node, bins + missing).

    ``active`` has (tree, nodes, features of each node) per tree, ``grown`` each tree's feature, cut bin, missing side and Hessian sums.
    The sums of ``parts`` tasks are added by the driver if all of them together are small, and else in a shuffle;
    they are integers, so it makes no difference to the result.
    """
    per_node = active[0][2].shape[1] if active else width
    span = bins + 1
    sizes = [len(nodes) for _, nodes, _ in active]
    offsets = np.cumsum([0, *sizes])
    cells = int(offsets[-1]) * per_node * span

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g_sum, h_sum = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for batch in batches:
            for x, y, hashes in _unpacked(batch, width):
                ready = gradients(x, y, hashes)
                for k, (tree, nodes, features) in enumerate(active):
                    rows, g, h = ready(tree)
                    part = x if rows is None else x[:, rows]
                    at = descended(part, *grown[k][:3], levels)
                    place = np.full(len(grown[k][0]), -1, np.int64)
                    place[nodes] = np.arange(len(nodes))
                    local = place[at]
                    here = np.flatnonzero(local >= 0)
                    if not len(here):
                        continue
                    local, g, h = local[here], g[here], h[here]
                    size = len(nodes) * per_node * span
                    begin = int(offsets[k]) * per_node * span
                    for j in range(per_node):
                        v = part[features[local, j], here].astype(np.int64)
                        cell = (local * per_node + j) * span + np.where(v == MISSING, bins, v)
                        g_sum[begin:begin + size] += np.bincount(cell, g, size).astype(np.int64)
                        h_sum[begin:begin + size] += np.bincount(cell, h, size).astype(np.int64)
        full = np.flatnonzero(h_sum)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(g_sum[full]), pa.array(h_sum[full])], names=["cell", "g", "h"])

    found = blocks.mapInArrow(sums, SUMS)
    if parts * cells > DRIVER_CELLS:
        found = found.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    found = found.toArrow()
    g, h = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    at = found.column("cell").to_numpy()
    np.add.at(g, at, found.column("g").to_numpy())
    np.add.at(h, at, found.column("h").to_numpy())
    shape = (int(offsets[-1]), per_node, span)
    return g.astype(float).reshape(shape), h.astype(float).reshape(shape)


def best_splits(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> dict[str, np.ndarray]:
    """Best split of every node: place among its features, cut bin, missing side, gain, and both sides' sums.

    Ties go to the first feature, the lowest cut, and missing values to the left.
    """
    missing_g, missing_h = g[:, :, -1:], h[:, :, -1:]
    left_g, left_h = np.cumsum(g[:, :, :-1], axis=2), np.cumsum(h[:, :, :-1], axis=2)
    total_g, total_h = left_g[:, :, -1:] + missing_g, left_h[:, :, -1:] + missing_h

    def part(a, b):
        return np.where(b + penalty > 0, a * a / np.where(b + penalty > 0, b + penalty, 1.0), 0.0)

    ways = []
    for extra_g, extra_h in ((missing_g, missing_h), (0.0, 0.0)):
        lg, lh = left_g + extra_g, left_h + extra_h
        rg, rh = total_g - lg, total_h - lh
        gain = part(lg, lh) + part(rg, rh) - part(total_g, total_h)
        ways.append((np.where((lh >= least) & (rh >= least) & (lh > 0) & (rh > 0), gain, -np.inf), lg, lh, rg, rh))
    gains = np.stack([w[0] for w in ways], axis=-1)
    n, features, cuts, sides = gains.shape
    best = gains.reshape(n, -1).argmax(axis=1)
    j, b, side = np.unravel_index(best, (features, cuts, sides))
    rows = np.arange(n)
    pick = lambda i: np.where(side == 0, ways[0][i][rows, j, b], ways[1][i][rows, j, b])
    return {"feature": j, "cut": b, "left": side == 0, "gain": pick(0), "lg": pick(1), "lh": pick(2), "rg": pick(3), "rh": pick(4)}


def _empty(trees: int, depth: int) -> dict[str, np.ndarray]:
    shape = (trees, 2 ** (depth + 1) - 1)
    return {"feature": np.full(shape, -1, np.int64), "cut_bin": np.zeros(shape, np.int64), "left": np.ones(shape, bool),
            "g": np.zeros(shape), "h": np.zeros(shape), "gain": np.zeros(shape)}


def _grow(sums: Callable, trees: Sequence[int], depth: int, width: int, bins: int, penalty: float, least: float,
          most: int, seed: int, slight: float, cells: int) -> dict[str, np.ndarray]:
    """Grow trees level by level; the sums of each node's rows are left in g and h.

    ``sums`` gets active nodes, grown trees and the level, and returns :func:`histograms` of at most about ``cells`` cells.
    """
    out = _empty(len(trees), depth)
    open_nodes = [np.array([0]) for _ in trees]
    for level in range(depth):
        # trees are summed together as long as the histogram stays within its bound
        groups, size = [[]], 0
        for k, nodes in enumerate(open_nodes):
            need = len(nodes) * min(most, width) * (bins + 1)
            if groups[-1] and size + need > cells:
                groups.append([])
                size = 0
            if len(nodes):
                groups[-1].append(k)
                size += need
        following = [np.zeros(0, np.int64) for _ in trees]
        for group in filter(None, groups):
            active = [(trees[k], open_nodes[k], np.array([chosen_features(trees[k], int(n), width, most, seed) for n in open_nodes[k]])) for k in group]
            grown = [(out["feature"][k], out["cut_bin"][k], out["left"][k], out["h"][k]) for k in group]
            g, h = sums(active, grown, level)
            best = best_splits(g, h, penalty, least)
            row = 0
            for k, (_, nodes, features) in zip(group, active, strict=True):
                part = slice(row, row + len(nodes))
                if level == 0:
                    out["g"][k, 0], out["h"][k, 0] = g[row, 0].sum(), h[row, 0].sum()
                good = np.flatnonzero(best["gain"][part] > slight * np.maximum(1.0, h[part, 0].sum(axis=1)))
                at, here = nodes[good], row + good
                out["feature"][k, at] = features[good, best["feature"][here]]
                out["cut_bin"][k, at], out["left"][k, at] = best["cut"][here], best["left"][here]
                out["gain"][k, at] = best["gain"][here]
                for side, a, b in ((1, "lg", "lh"), (2, "rg", "rh")):
                    out["g"][k, 2 * at + side], out["h"][k, 2 * at + side] = best[a][here], best[b][here]
                following[k] = np.sort(np.concatenate([2 * at + 1, 2 * at + 2]))
                row += len(nodes)
        open_nodes = following
    return out


def _cuts_of(grown: dict, cuts: list[np.ndarray]) -> np.ndarray:
    """Cut values; a cut behind the last point sends every present value to the left."""
    out = np.full(grown["feature"].shape, np.inf)
    for j, points in enumerate(cuts):
        mine = grown["feature"] == j
        bins = grown["cut_bin"][mine]
        out[mine] = np.where(bins < len(points), points[np.minimum(bins, max(len(points) - 1, 0))] if len(points) else np.inf, np.inf)
    return out


def _facts(blocks: DataFrame) -> tuple[int, float, float, float]:
    """Rows, mean, least and greatest target; sums of blocks in exact order-free form."""
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = [np.frombuffer(y, float) for y in batch.column("y").to_pylist()]
            if ys:
                yield pa.RecordBatch.from_arrays([pa.array([len(y) for y in ys]), pa.array([float(y.min()) for y in ys]), pa.array([float(y.max()) for y in ys])], names=["n", "lo", "hi"])

    n, lo, hi = blocks.mapInArrow(facts, "n long, lo double, hi double").agg(F.sum("n"), F.min("lo"), F.max("hi")).first()
    if not n:
        raise ValueError("no row has a target")
    unit = 2.0**30 / max(abs(lo), abs(hi), 1e-300)

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = [int(np.rint(np.frombuffer(y, float) * unit).astype(np.int64).sum()) for y in batch.column("y").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int64())], names=["s"])

    total = blocks.mapInArrow(rounded, "s long").agg(F.sum(F.col("s").cast("decimal(38,0)"))).first()[0]
    return int(n), float(int(total) / unit / n), float(lo), float(hi)


def _margins(x: np.ndarray, begin: np.ndarray, trees: list[dict], depth: int) -> np.ndarray:
    out = begin.copy()
    for t in trees:
        out += t["value"][descended(x, t["feature"], t["cut_bin"], t["left"], depth)]
    return out


def _with_margins(blocks: DataFrame, trees: list[dict], depth: int, width: int, base: float, first: bool) -> DataFrame:
    """The blocks with the margins after ``trees`` in place of the last column, written."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (x, y, m) in _unpacked(batch, width):
                begin = np.full(len(y), base) if first else np.frombuffer(m.tobytes(), float)
                out.append(_margins(x, begin, trees, depth).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["n", "bins", "y", "hash"])

    return settle(blocks.mapInArrow(add, blocks.schema), "margins")


def boosted(df: DataFrame, cols: Sequence[str], target: str, link: str, rounds: int, depth: int, step: float, penalty: float = 1.0,
            least: float = 1.0, bins: int = 64) -> TreeEnsemble:
    """Gradient boosting on second-order statistics; ``link`` is "logistic" for 0/1 targets or "value" for squared loss."""
    width, spark = len(cols), df.sparkSession
    with scratch(spark):
        blocks, cuts = prepared(df, cols, target, bins, plain_columns(df), False)
        n, mean, lo, hi = _facts(blocks)
        if link == "logistic" and (lo < 0 or hi > 1):
            raise ValueError("classes must be 0 and 1")
        mean = min(max(mean, 1e-6), 1 - 1e-6) if link == "logistic" else mean
        base = float(np.log(mean / (1 - mean))) if link == "logistic" else mean
        # gradients as integers: a block's sums stay exact in floats, the whole table's in 64 bits
        unit = 2.0 ** min(30, 61 - n.bit_length()) / (1.0 if link == "logistic" else max(2 * (hi - lo), 1e-300))
        h_unit = 2.0 ** min(30, 61 - n.bit_length()) if link == "logistic" else 1.0
        ratio = unit / h_unit

        def gradients(margin, y):
            if link != "logistic":
                return np.rint((margin - y) * unit), None
            p = 1 / (1 + np.exp(-margin))
            return np.rint((p - y) * unit), np.rint(np.maximum(p * (1 - p), 1e-16) * h_unit)

        def tree(r: int, sums: Callable, cells: int) -> dict:
            grown = _grow(sums, [r], depth, width, bins, penalty * h_unit, least * h_unit, width, 0, 1e-12 * ratio * ratio, cells)
            value = -(grown["g"] / unit) / (grown["h"] / h_unit + penalty) * step
            return {"feature": grown["feature"][0], "cut_bin": grown["cut_bin"][0], "left": grown["left"][0], "value": value[0],
                    "cut": _cuts_of(grown, cuts)[0], "gain": grown["gain"][0] * h_unit / unit**2}

        def fit(batches: Iterator[pa.RecordBatch], added: Callable) -> list[dict]:
            rows = held.Boosted((b for batch in batches for b in _unpacked(batch, width)), width, bins, MISSING, added, 2 ** (depth + 1) - 1)
            done: list[dict] = []
            for r in range(rounds):
                rows.round(base, done[-1] if done else None, gradients)
                done.append(tree(r, rows.histograms, min(CELLS, held.CELLS)))
            return done

        tasks = _tasks(spark, n)
        done = held.run(blocks, tasks, fit) if tasks else None
        if done is None:
            done = _boosted_by_jobs(blocks, rounds, depth, width, bins, base, gradients, tree)
    stack = lambda name: np.stack([t[name] for t in done])
    return TreeEnsemble(tuple(cols), link, base, False, stack("feature"), stack("cut"), stack("left"), stack("value"), stack("gain"))


def _tasks(spark: SparkSession, n: int) -> int:
    """Tasks that keep the rows of a fit, at most one for so many rows; 0 for a job a level."""
    return min(held.slots(spark), -(-n // TASK_ROWS))


def _boosted_by_jobs(blocks: DataFrame, rounds: int, depth: int, width: int, bins: int, base: float, gradients: Callable, tree: Callable) -> list[dict]:
    """The trees, from a job per level; margins are written every few rounds."""
    now = _with_margins(blocks, [], depth, width, base, True).persist()
    parts = now.rdd.getNumPartitions()
    recent: list[dict] = []
    done: list[dict] = []
    for r in range(rounds):
        fresh = list(recent)

        def of_block(x, y, hashes, fresh=fresh):
            g, h = gradients(_margins(x, np.frombuffer(hashes.tobytes(), float), fresh, depth), y)
            h = np.ones(len(y)) if h is None else h
            return lambda tree: (None, g, h)

        def sums(active, grown, level, now=now, parts=parts, of_block=of_block):
            return histograms(now, parts, of_block, active, grown, level, width, bins)

        recent.append(tree(r, sums, CELLS))
        done.append(recent[-1])
        if (r + 1) % REFRESH == 0 and r + 1 < rounds:
            before, now = now, _with_margins(now, recent, depth, width, base, False).persist()
            before.unpersist()
            parts, recent = now.rdd.getNumPartitions(), []
    now.unpersist()
    return done


def forest(df: DataFrame, cols: Sequence[str], target: str, link: str, trees: int, depth: int, most: int | None = None, least: float = 1.0,
           bins: int = 32, seed: int = 42, key: Sequence[str] | None = None) -> TreeEnsemble:
    """Bagged trees; ``link`` is "share" for 0/1 targets or "value". ``most`` features are tried at a node (default all).

    Rows are drawn by the hash of ``key`` (default: all columns of ``df``).
    """
    width, spark = len(cols), df.sparkSession
    with scratch(spark):
        blocks, cuts = prepared(df, cols, target, bins, list(key or plain_columns(df)), True)
        n, mean, lo, hi = _facts(blocks)
        if link == "share" and (lo < 0 or hi > 1):
            raise ValueError("classes must be 0 and 1")
        # targets around their mean, as integers
        unit = 2.0 ** min(28, 58 - n.bit_length()) / max(hi - lo, 1e-300)

        def rounded(y):
            return np.rint((mean - y) * unit)

        def grow(sums: Callable, some: Sequence[int], cells: int) -> dict[str, np.ndarray]:
            return _grow(sums, some, depth, width, bins, 0.0, least, most or width, seed, 1e-9, cells)

        tasks = _tasks(spark, n)
        # seven bytes for each of the rows drawn, about two thirds
        together = max(1, min(held.TREES, (held.HELD_BYTES - held.BASE_BYTES) * max(tasks, 1) // (5 * n)))

        def fit(batches: Iterator[pa.RecordBatch], added: Callable) -> dict[str, np.ndarray]:
            rows = held.Bagged((b for batch in batches for b in _unpacked(batch, width)), width, bins, MISSING, added, 2 ** (depth + 1) - 1,
                               draw=lambda hashes, tree: bootstrap(hashes, tree, seed), target=rounded)
            parts = []
            for first in range(0, trees, together):
                rows.start(first)
                parts.append(grow(rows.histograms, range(first, min(first + together, trees)), min(CELLS, held.CELLS)))
            return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}

        grown = held.run(blocks, tasks, fit) if tasks else None
        if grown is None:
            def of_block(x, y, hashes):
                g = rounded(y)

                def of(tree: int):
                    weights = bootstrap(hashes, tree, seed)
                    rows = np.flatnonzero(weights)
                    return rows, g[rows] * weights[rows], weights[rows].astype(float)

                return of

            blocks = blocks.persist()
            parts = blocks.rdd.getNumPartitions()
            grown = grow(lambda active, grown, level: histograms(blocks, parts, of_block, active, grown, level, width, bins), range(trees), CELLS)
            blocks.unpersist()
    value = mean - np.divide(grown["g"], grown["h"], out=np.zeros_like(grown["g"]), where=grown["h"] > 0) / unit
    return TreeEnsemble(tuple(cols), link, 0.0, True, grown["feature"], _cuts_of(grown, cuts), grown["left"], value, grown["gain"] / unit**2)

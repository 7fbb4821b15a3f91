"""Rows of a tree fit that stay in their tasks from the first split to the last.

One stage of tasks that wait for each other (barrier mode) runs a whole fit.  A task reads its blocks once and keeps, per
row, its bins, target, margin and node; up to a bound in memory, behind that in a file of the task without a name.  At
each level every task sums its own rows, the tasks exchange their sums by files in the shared folder, and every task finds
the same splits from them.  Sums are integers, so neither the number of tasks nor their order matters.

Of two siblings only the one with the smaller Hessian sum is summed; the other is their parent less that one, to the unit.
"""

from __future__ import annotations

import os
import pickle
import sys
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession

from torqueline.session import scratch_path, shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

TASKS = 16  # every task gets the sums of every other one, so more tasks than this take a job a level instead
CHUNK = 1 << 16  # rows worked on together
FLUSH = 1 << 22  # rows; a float holds the sums of so many rounded gradients exactly
BASE_BYTES = 96 << 20  # of what is read, in the memory of a task
HELD_BYTES = 224 << 20  # of what is read and the state of the rows
PAIR_CELLS = 1 << 17  # cells of two features together
CELLS = 1 << 16  # histogram cells that a task sends at once
TREES = 32  # of a forest, grown side by side


def shared_path(spark: SparkSession, path: str) -> str | None:
    """A path of the shared folder as plain files know it, if they do."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    return place.toUri().getPath() if known else None


def slots(spark: SparkSession) -> int:
    """Tasks that can run side by side for a whole fit; 0 if there are too many, if their number may change, or without plain shared files."""
    context = spark.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true" or not shared_path(spark, shared_dir(spark)):
        return 0
    inner = context._jsc.sc()
    n = min(context.defaultParallelism, inner.maxNumConcurrentTasks(inner.resourceProfileManager().defaultResourceProfile()))
    return n if n <= TASKS else 0


class Meeting:
    """Sums over the tasks of a stage, by files in the shared folder; a message of Spark's own barrier takes a second."""

    def __init__(self, place: str, rank: int, tasks: int):
        self.place, self.rank, self.tasks, self.turn = place, rank, tasks, 0
        os.makedirs(place, exist_ok=True)

    def _name(self, turn: int, rank: int) -> str:
        return os.path.join(self.place, f"{turn}-{rank}")

    def added(self, x: np.ndarray) -> np.ndarray:
        """The sum of the arrays that all tasks bring."""
        mine = self._name(self.turn, self.rank)
        x.tofile(f"{mine}.part")
        os.rename(f"{mine}.part", mine)
        total = x.copy()
        for rank in range(self.tasks):
            if rank != self.rank:
                other, nap = self._name(self.turn, rank), 0.0005
                while not os.path.exists(other):
                    time.sleep(nap)
                    nap = min(2 * nap, 0.004)
                total += np.fromfile(other, x.dtype)
        if self.turn:
            os.remove(self._name(self.turn - 1, self.rank))  # all have brought the next one, so they have read it
        self.turn += 1
        return total


def run(blocks: DataFrame, tasks: int, work: Callable):
    """What ``work`` returns in the first of the tasks, none if a task does not see the shared folder.

    It gets the task's blocks and a function that adds arrays over all tasks.
    """
    path = shared_path(blocks.sparkSession, scratch_path(blocks.sparkSession, "sums"))
    os.makedirs(path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        if tasks == 1:
            found = work(batches, lambda x: x)
        else:
            said = context.allGather(uuid.uuid4().hex if os.path.isdir(path) else "")  # a stage that is run again meets elsewhere
            found = work(batches, Meeting(os.path.join(path, said[0]), context.partitionId(), tasks).added) if all(said) else None
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["found"])

    return pickle.loads(blocks.repartition(tasks).mapInArrow(task, "found binary", barrier=True).collect()[0][0])


class Store:
    """Arrays by name, in memory up to a bound and else in a file."""

    def __init__(self):
        self.arrays: dict[tuple, np.ndarray] = {}
        self.places: dict[tuple, tuple[int, int, np.dtype, int]] = {}
        self.bytes = self.end = 0
        self.file = None

    def put(self, key: tuple, x: np.ndarray, most: int) -> None:
        old = self.arrays.pop(key, None)
        self.bytes -= 0 if old is None else old.nbytes
        if key not in self.places and self.bytes + x.nbytes <= most:
            self.arrays[key] = x
            self.bytes += x.nbytes
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        begin, room, *_ = self.places.get(key, (0, -1))
        if room < x.nbytes:
            begin, room = self.end, x.nbytes + x.nbytes // 50 + 4096  # the next array of the name may be a little longer
            self.end += room
        self.file.seek(begin)
        self.file.write(np.ascontiguousarray(x).data)
        self.places[key] = (begin, room, x.dtype, x.size)

    def get(self, key: tuple) -> np.ndarray:
        if key in self.arrays:
            return self.arrays[key]
        begin, _, dtype, size = self.places[key]
        self.file.seek(begin)
        out = np.empty(size, dtype)
        self.file.readinto(out.data.cast("B"))
        return out

    def drop(self, key: tuple) -> None:
        """The place in the file stays for the next array of this name."""
        old = self.arrays.pop(key, None)
        self.bytes -= 0 if old is None else old.nbytes


class Rows:
    """The rows of a task in chunks, and their nodes in the trees that are being grown.

    Bins are numbered from 0, a missing value is ``bins``.
    """

    def __init__(self, blocks: Iterator[tuple], width: int, bins: int, missing: int, added: Callable, nodes: int):
        self.width, self.bins, self.added, self.nodes = width, bins, added, nodes
        self.store, self.sizes = Store(), []
        self.first = 0  # number of the first of the trees that are being grown
        self.parents: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        waiting, n = [], 0
        for block in blocks:
            if n + len(block[1]) > CHUNK and n:
                self._keep(waiting, missing)
                waiting, n = [], 0
            waiting.append(block)
            n += len(block[1])
        if n:
            self._keep(waiting, missing)

    def _keep(self, waiting: list[tuple], missing: int) -> None:
        k, x = len(self.sizes), np.concatenate([w[0] for w in waiting], axis=1)
        x[x == missing] = self.bins
        self.sizes.append(x.shape[1])
        self.store.put((k, "bins"), x.ravel(), BASE_BYTES)
        even = self.width // 2 * 2
        self.store.put((k, "pairs"), (x[0:even:2].astype(np.uint16) * (self.bins + 1) + x[1:even:2]).ravel(), BASE_BYTES)
        for i, name in ((1, "y"), (2, "hash")):
            self.store.put((k, name), np.concatenate([w[i] for w in waiting]), BASE_BYTES)

    def put(self, k: int, name: str, x: np.ndarray, tree: int) -> None:
        self.store.put((k, name, tree - self.first), x, HELD_BYTES)

    def get(self, k: int, name: str, tree: int | None = None) -> np.ndarray:
        return self.store.get((k, name) if tree is None else (k, name, tree - self.first))

    # what a kind of model knows of its rows

    def begun(self, k: int, tree: int) -> None:
        """Rows of a chunk enter the root of a tree."""

    def rows(self, k: int, tree: int) -> np.ndarray | None:
        """Places of the rows that are in the tree; none for all."""

    def sums_of(self, k: int, tree: int) -> Callable:
        """Gradients and Hessians of chosen ones of these rows (none for all); no Hessians where each is 1."""
        raise NotImplementedError

    def moved(self, k: int, tree: int, node: np.ndarray, first: int) -> np.ndarray:
        """The nodes to go on with; rows that ended above ``first``, the level's first node, may go."""
        return node

    # ---- growing

    def _descend(self, k: int, tree: int, grown: tuple, x: np.ndarray, level: int) -> np.ndarray:
        """Nodes of the rows one level further down."""
        feature, cut_bin, left = (a[:2**level - 1] for a in grown[:3])
        n, span, rows = self.sizes[k], self.bins + 1, self.rows(k, tree)
        if level == 1:
            if feature[0] < 0:
                return np.zeros(n if rows is None else len(rows), np.uint16)
            v = x[feature[0] * n:(feature[0] + 1) * n]
            return self._steps(feature, cut_bin, left).take(v if rows is None else v.take(rows), mode="clip")
        at = self.get(k, "node", tree).astype(np.int64)
        from_ = (np.maximum(feature, 0) * n).take(at, mode="clip")
        from_ += np.arange(n) if rows is None else rows
        at *= span
        at += x.take(from_, mode="clip")
        return self._steps(feature, cut_bin, left).take(at, mode="clip")

    def _steps(self, feature: np.ndarray, cut_bin: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The next node by node and bin; a leaf is its own."""
        v, node = np.arange(self.bins + 1), np.arange(len(feature))[:, None]
        right = np.where(v == self.bins, ~left[:, None], v > cut_bin[:, None])
        return np.where(feature[:, None] < 0, node, 2 * node + 1 + right).astype(np.uint16).ravel()

    def histograms(self, active: list[tuple[int, np.ndarray, np.ndarray]], grown: list[tuple], level: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradients and Hessians over all tasks, shape (active nodes, features of a node, bins + missing)."""
        per_node, span = active[0][2].shape[1], self.bins + 1
        whole = per_node == self.width
        summed, place = [], []
        for (tree, nodes, _), of in zip(active, grown, strict=True):
            mine = np.ones(len(nodes), bool)
            if level and whole:
                h = of[3][nodes].reshape(-1, 2)
                mine = np.stack([h[:, 0] <= h[:, 1], h[:, 0] > h[:, 1]], axis=1).ravel()
            summed.append(mine)
            place.append(np.full(self.nodes, -1, np.int64))
            place[-1][nodes[mine]] = np.arange(mine.sum())
        sizes = [int(m.sum()) for m in summed]
        ends = np.cumsum(sizes)
        shape = (2, int(ends[-1]), per_node, span)
        # two features counted in one go, as long as the cells of both stay in a cache
        paired = whole and self.width > 1 and int(ends[-1]) * span * span <= PAIR_CELLS
        pairs = self.width // 2 if paired else 0
        now, joint = np.zeros(shape), np.zeros((2, pairs, int(ends[-1]), span, span))
        total, waiting = np.zeros(shape, np.int64), 0

        def flush() -> None:
            now[:, :, 0:2 * pairs:2] += joint.sum(axis=4).transpose(0, 2, 1, 3)
            now[:, :, 1:2 * pairs:2] += joint.sum(axis=3).transpose(0, 2, 1, 3)
            np.add(total, now.astype(np.int64), out=total)
            now[:], joint[:] = 0, 0

        for k, n in enumerate(self.sizes):
            if waiting + n > FLUSH:
                flush()
                waiting = 0
            waiting += n
            x = self.get(k, "bins")
            both = self.get(k, "pairs") if pairs else None
            for i, (tree, _, features) in enumerate(active):
                if level == 0:
                    self.begun(k, tree)
                    node = None
                else:
                    node = self.moved(k, tree, self._descend(k, tree, grown[i], x, level), 2**level - 1)
                    self.put(k, "node", node, tree)
                mine = slice(ends[i] - sizes[i], ends[i])
                self._sum(k, tree, x, both, node, place[i], None if whole else features[summed[i]], now[:, mine], joint[:, :, mine])
        flush()
        g, h = self.added(total.ravel()).reshape(shape)
        if not (level and whole):
            self._remember(active, g, h, whole)
            return g.astype(float), h.astype(float)
        all_g, all_h = (np.empty((sum(len(nodes) for _, nodes, _ in active), per_node, span), np.int64) for _ in "gh")
        at = 0
        for i, (tree, nodes, _) in enumerate(active):
            known, known_g, known_h = self.parents[tree]
            parent = np.searchsorted(known, (nodes[::2] - 1) // 2)
            for every, some, before in ((all_g, g, known_g), (all_h, h, known_h)):
                here, part = every[at:at + len(nodes)], some[ends[i] - sizes[i]:ends[i]]
                here[summed[i]] = part
                here[~summed[i]] = before[parent] - part
            at += len(nodes)
        self._remember(active, all_g, all_h, whole)
        return all_g.astype(float), all_h.astype(float)

    def _remember(self, active: list, g: np.ndarray, h: np.ndarray, whole: bool) -> None:
        at = 0
        for tree, nodes, _ in active if whole else ():
            self.parents[tree] = (nodes, g[at:at + len(nodes)], h[at:at + len(nodes)])
            at += len(nodes)

    def _sum(self, k: int, tree: int, x: np.ndarray, both: np.ndarray | None, node: np.ndarray | None, place: np.ndarray, features: np.ndarray | None,
             out: np.ndarray, joint: np.ndarray) -> None:
        """Add the rows in the places to ``out``, or to ``joint`` by pairs of features; ``features`` has those of each place, none for all."""
        n, rows, sums = self.sizes[k], self.rows(k, tree), self.sums_of(k, tree)
        count, per_node, span = out.shape[1:]
        local = chosen = None
        if node is not None:
            local = place.take(node, mode="clip")
            chosen = np.flatnonzero(local >= 0)
            if not len(chosen):
                return
            local = local.take(chosen)
            rows = chosen if rows is None else rows.take(chosen)
        g, h = sums(chosen)

        def add(v: np.ndarray, cells: int, to: np.ndarray) -> None:
            cell = v.astype(np.int64) if local is None else local * cells + v
            for i, weights in enumerate((g, h)):
                to[i] += np.bincount(cell, weights, count * cells).reshape(to[i].shape)

        def of_all(columns: np.ndarray, j: int) -> np.ndarray:
            v = columns[j * n:(j + 1) * n]
            return v if rows is None else v.take(rows, mode="clip")

        pairs = joint.shape[1]
        for j in range(pairs):
            add(of_all(both, j), span * span, joint[:, j])
        for j in range(2 * pairs, per_node):
            if features is None or local is None:
                v = of_all(x, j if features is None else features[0, j])
            else:
                v = x.take(features[:, j].take(local) * n + rows, mode="clip")
            add(v, span, out[:, :, j])


class Boosted(Rows):
    """All rows are in every tree; margins follow the trees."""

    named = "gh"

    def round(self, base: float, last: dict | None, gradients: Callable) -> None:
        """Margins after the last tree, and the gradients of the next one."""
        for k, n in enumerate(self.sizes):
            if last is None:
                margin = np.full(n, base)
            else:
                margin = self.get(k, "margin", 0)
                if self.depth:
                    x = self.get(k, "bins")
                    margin = margin + last["value"].take(self._descend(k, 0, (last["feature"], last["cut_bin"], last["left"]), x, self.depth), mode="clip")
                else:
                    margin = margin + last["value"][0]
            g, h = gradients(margin, self.get(k, "y"))
            self.named = "g" if h is None else "gh"
            for name, v in (("margin", margin), ("g", g), ("h", h)):
                if v is not None:
                    self.put(k, name, v, 0)
        self.depth, self.parents = 0, {}

    def histograms(self, active, grown, level):
        self.depth = level + 1
        return super().histograms([(0, *active[0][1:])], grown, level)

    def sums_of(self, k, tree):
        g, h = (self.get(k, name, 0) if name in self.named else None for name in "gh")
        return lambda chosen: tuple(v if v is None or chosen is None else v.take(chosen) for v in (g, h))


class Bagged(Rows):
    """Rows are in a tree as often as they are drawn."""

    def __init__(self, *args, draw: Callable, target: Callable):
        super().__init__(*args)
        self.draw = draw
        for k in range(len(self.sizes)):
            self.store.put((k, "y"), target(self.get(k, "y")), BASE_BYTES)

    def begun(self, k, tree):
        weights = self.draw(self.get(k, "hash"), tree)
        rows = np.flatnonzero(weights)
        self.put(k, "rows", rows.astype(np.int32), tree)
        self.put(k, "weights", weights[rows].astype(np.uint8), tree)

    def rows(self, k, tree):
        return self.get(k, "rows", tree).astype(np.int64)

    def sums_of(self, k, tree):
        rows, weights, y = self.rows(k, tree), self.get(k, "weights", tree), self.get(k, "y")

        def sums(chosen):
            at, w = (rows, weights) if chosen is None else (rows.take(chosen), weights.take(chosen))
            w = w.astype(float)
            return y.take(at) * w, w

        return sums

    def moved(self, k, tree, node, first):
        on = node >= first
        if np.count_nonzero(on) < 0.9 * len(on):
            for name in ("rows", "weights"):
                self.put(k, name, self.get(k, name, tree)[on], tree)
            node = node[on]
        return node

    def start(self, first: int) -> None:
        """Go on with the trees from ``first``."""
        for key in [key for key in self.store.arrays if len(key) == 3]:
            self.store.drop(key)
        self.first, self.parents = first, {}

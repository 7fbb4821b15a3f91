"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Every word is a vector of word and character inputs: how much the word, and the runs of bytes it is made of,
set toxic training documents apart (log-odds in standard deviations, after an informative prior), and
random signs of the runs.  A word of more than 64 bytes is read as overlapping pieces, each in a place of
its own.  Two gated recurrent layers read a window of words in both directions, an attention layer weighs the places, and the pooled state gives the window's logit.  A document is as toxic
as its worst window, in training (only that window gets a gradient) and in scoring, where all overlapping
windows of the whole text are scored in lockstep.

The network is fitted on the driver from a bounded sample of labelled rows: at most ``positives`` and
``negatives`` documents of at most ``longest`` characters, the smallest by a hash of the id.  Inputs of a score
are the text alone.

Defined results: a text without words scores 0.  Without labels of both classes every other score is the share of class 1 among the labels, or 0.  Repeated rows and null ids give a row each; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import sys
from collections.abc import Iterable
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torqueline.llm.base import with_text_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = re.compile(r"\w+")
BUCKETS = 1 << 16
SIGNS = 8
WIDTH = 4 + SIGNS
WINDOW, STRIDE = 32, 24
GROUP_WORDS = 200_000
MOST_CACHED = 200_000
PIECE, OVERLAP = 64, 16  # bytes


def pieces_of(word: str) -> list[str]:
    """The word, or consecutive pieces of at most ``PIECE`` bytes, neighbours sharing about ``OVERLAP``; whole characters."""
    data = word.encode("utf-8", "surrogatepass")
    out, at = [], 0
    while True:
        end = min(at + PIECE, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end].decode("utf-8", "surrogatepass"))
        if end == len(data):
            return out
        at = end - OVERLAP
        while data[at] & 0xC0 == 0x80:
            at -= 1


def words_of(text: str | None) -> list[str]:
    """Words, long ones in pieces; scripts without spaces and joined words are read to their end."""
    found = WORD.findall((text or "").lower())
    if max(map(len, found), default=0) * 4 <= PIECE:
        return found
    return [p for w in found for p in (pieces_of(w) if len(w) * 4 > PIECE else (w,))]


def _buckets(found: list[str]) -> np.ndarray:
    return np.array([crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in found], np.int64)


def _runs(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the runs of three to five bytes in each word, its ends marked.

    Returns buckets and whether they stand for a run, both by run length and first byte over all words joined,
    and where each word begins.  Every word has a run of three.
    """
    marked = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in found]
    sizes = np.array([len(m) for m in marked], np.int64)
    ends = sizes.cumsum()
    data = np.concatenate([np.frombuffer(b"".join(marked), np.uint8).astype(np.int64), np.zeros(4, np.int64)])
    n = len(data) - 4
    left = np.repeat(ends, sizes) - np.arange(n)
    rolled, buckets = data[:n] * 257 + data[1:n + 1], []
    for size in (3, 4, 5):
        rolled = rolled * 257 + data[size - 1:n + size - 1]
        buckets.append((rolled * 0x9E3779B1 + size >> 15) & (BUCKETS - 1))
    return np.array(buckets), left >= np.array([3, 4, 5])[:, None], ends - sizes


def _contrast(ones: np.ndarray, zeros: np.ndarray, n_one: int, n_zero: int, prior: float = 2.0) -> np.ndarray:
    """Log-odds of presence in class 1 against class 0, in standard deviations, cut at 6 and scaled."""
    a, b = ones + prior, zeros + prior
    z = (np.log(a / (n_one + 2 * prior)) - np.log(b / (n_zero + 2 * prior))) / np.sqrt(1 / a + 1 / b)
    return (np.clip(z, -6, 6) / 3).astype(np.float32)


@dataclass
class Inputs:
    """Word vectors from two contrast tables."""

    by_word: np.ndarray
    by_run: np.ndarray

    def vectors(self, found: list[str]) -> np.ndarray:
        out = np.zeros((len(found), WIDTH), np.float32)
        if not found:
            return out
        buckets, real, at = _runs(found)
        many = np.add.reduceat(real.sum(axis=0), at)
        z = self.by_run[buckets]
        out[:, 0] = self.by_word[_buckets(found)]
        out[:, 1] = np.maximum.reduceat(np.where(real, z, -9).max(axis=0), at)
        out[:, 2] = np.minimum.reduceat(np.where(real, z, 9).min(axis=0), at)
        out[:, 3] = np.add.reduceat(np.where(real, z, 0).sum(axis=0), at) / many
        for bit in range(SIGNS):
            signs = np.where(real, (buckets >> bit & 1) * 2 - 1, 0).sum(axis=0)
            out[:, 4 + bit] = np.add.reduceat(signs, at) / many
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.where(x == -np.inf, 0.0, 1 / (1 + np.exp(-np.clip(x, -30, 30))))


@dataclass
class Network:
    """Two gated recurrent layers, attention and a logit; word 0 of a window's numbers is the empty place."""

    inputs: Inputs
    hidden: int
    p: dict[str, np.ndarray]
    shift: float = 0.0
    rows: dict[str, int] = field(default_factory=dict)
    cached: dict[str, np.ndarray] = field(default_factory=dict)

    def project(self, x: np.ndarray, side: str) -> np.ndarray:
        """Input parts of the gates for word vectors ``x``, with the empty place in front, which keeps the state."""
        empty = np.zeros((1, 3 * self.hidden), np.float32)
        empty[0, :self.hidden] = 30
        return np.concatenate([empty, x @ self.p["w" + side] + self.p["b" + side]])

    def _layer(self, gates: np.ndarray, ids: np.ndarray, side: str, keep: list | None) -> list[np.ndarray]:
        """States after each place; ``keep`` gets what the gradient needs."""
        k, u = self.hidden, self.p["u" + side]
        h = np.zeros((len(ids), k), np.float32)
        out: list[np.ndarray] = [h] * ids.shape[1]
        for t in range(ids.shape[1]) if side == "f" else reversed(range(ids.shape[1])):
            g, hu = gates[ids[:, t]], h @ u
            zr = 1 / (1 + np.exp(-(g[:, :2 * k] + hu[:, :2 * k])))
            z, r = zr[:, :k], zr[:, k:]
            n = np.tanh(g[:, 2 * k:] + r * hu[:, 2 * k:])
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * k:]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def logits(self, gates: dict[str, np.ndarray], ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit per window of word numbers."""
        steps = {s: [] if keep is not None else None for s in "fb"}
        states = np.concatenate([np.stack(self._layer(gates[s], ids, s, steps[s]), axis=1) for s in "fb"], axis=2)
        u = np.tanh(states @ self.p["wa"])
        e = u @ self.p["va"] - 30 * (ids == 0)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,ntk->nk", a, states)
        if keep is not None:
            keep.update(steps=steps, states=states, u=u, a=a, pooled=pooled)
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gradient(self, x: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted logistic loss over windows ``ids`` into word vectors ``x``."""
        keep: dict = {}
        z = self.logits({s: self.project(x, s) for s in "fb"}, ids, keep)
        d = ((_sigmoid(z) - y) * weight / len(y)).astype(np.float32)
        a, u, states = keep["a"], keep["u"], keep["states"]
        g = {"wo": keep["pooled"].T @ d, "bo": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.p["wo"]
        da = np.einsum("nk,ntk->nt", dpool, states)
        de = a * (da - (a * da).sum(axis=1, keepdims=True))
        g["va"] = np.einsum("nt,nta->a", de, u)
        du = de[:, :, None] * self.p["va"] * (1 - u * u)
        g["wa"] = np.einsum("ntk,nta->ka", states, du)
        dstates = a[:, :, None] * dpool[:, None, :] + du @ self.p["wa"].T
        k = self.hidden
        vectors = np.concatenate([np.zeros((1, x.shape[1]), np.float32), x])
        for n, s in enumerate("fb"):
            gw, gu, gb = (np.zeros_like(self.p[c + s]) for c in "wub")
            dh = np.zeros((len(ids), k), np.float32)
            for t, h, zt, r, new, hun in reversed(keep["steps"][s]):
                dh = dh + dstates[:, t, n * k:(n + 1) * k]
                dn = dh * (1 - zt) * (1 - new * new)
                dz = dh * (h - new) * zt * (1 - zt)
                dr = dn * hun * r * (1 - r)
                word = (ids[:, t] > 0)[:, None]
                gates = np.concatenate([dz, dr, dn], axis=1) * word
                back = np.concatenate([dz, dr, dn * r], axis=1)
                gw += vectors[ids[:, t]].T @ gates
                gb += gates.sum(axis=0)
                gu += h.T @ back
                dh = dh * zt + back @ self.p["u" + s].T
            g |= {"w" + s: gw, "u" + s: gu, "b" + s: gb}
        return g

    def _numbers(self, texts: list[list[str]]) -> list[list[int]]:
        """Word numbers from 1; gates of new words join the cache, which is emptied when it is full."""
        if len(self.rows) > MOST_CACHED:
            self.rows.clear()
            self.cached.clear()
        old = len(self.rows)
        number = [[self.rows.setdefault(w, len(self.rows) + 1) for w in words] for words in texts]
        new = list(itertools.islice(self.rows, old, None))
        if new or not self.cached:
            x = self.inputs.vectors(new)
            for s in "fb":
                g = self.project(x, s).astype(np.float32)
                self.cached[s] = np.concatenate([self.cached[s], g[1:]]) if s in self.cached else g
        return number

    def document_logits(self, texts: Iterable[str | None]) -> np.ndarray:
        """The greatest window logit of each text; the texts are worked off in groups of bounded size."""
        out, group, size = [], [], 0
        for text in texts:
            group.append(words_of(text))
            size += len(group[-1])
            if size >= GROUP_WORDS:
                out.append(self._group(group))
                group, size = [], 0
        if group:
            out.append(self._group(group))
        return np.concatenate(out) if out else np.zeros(0)

    def _group(self, texts: list[list[str]]) -> np.ndarray:
        ids, of = windows(self._numbers(texts))
        best = np.full(len(texts), -np.inf)
        for i in range(0, len(ids), 4096):
            np.maximum.at(best, of[i:i + 4096], self.logits(self.cached, ids[i:i + 4096]))
        return np.where([len(t) > 0 for t in texts], best, -np.inf)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        return _sigmoid(self.document_logits(texts) - self.shift)


def windows(numbers: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows over each text's word numbers, filled up with 0, and the text each belongs to."""
    starts, of, parts, base = [], [], [], 0
    for n, words in enumerate(numbers):
        part = words if len(words) >= WINDOW else words + [0] * (WINDOW - len(words))
        last = len(part) - WINDOW
        own = [*range(0, last, STRIDE), last]
        starts += [base + s for s in own]
        of += [n] * len(own)
        parts.append(part)
        base += len(part)
    flat = np.fromiter(itertools.chain.from_iterable(parts), np.int32, base)
    return flat[np.array(starts, np.int64)[:, None] + np.arange(WINDOW)], np.array(of, np.int64)


def train(
    texts: list[str | None], labels: np.ndarray, hidden: int = 8, attention: int = 8, rounds: int = 12, batch: int = 256,
    step: float = 0.02, seed: int = 42, validation: float = 0.2,
) -> Network | None:
    """A network from labelled texts, or None if a class is missing; a fifth of them sets the decision level."""
    words = [words_of(t) for t in texts]
    y = np.asarray(labels, np.float32)
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < validation
    fit = np.flatnonzero(~held)
    if len(np.unique(y[fit])) < 2:
        return None
    vocabulary: dict[str, int] = {}
    numbers = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in words[n]] for n in fit]
    found = list(vocabulary)
    buckets, real, at = _runs(found) if found else (np.zeros((3, 0), np.int64), np.zeros((3, 0), bool), np.zeros(0, np.int64))
    runs = [b[r] for b, r in zip(np.split(buckets.T, at[1:]), np.split(real.T, at[1:]), strict=True)] if found else []
    by_word, by_run = _buckets(found), np.zeros((2, BUCKETS))
    counts = np.zeros((2, BUCKETS))
    for n, own in zip(fit, numbers, strict=True):
        if own:
            known = np.unique(own) - 1
            counts[int(y[n]), np.unique(by_word[known])] += 1
            by_run[int(y[n]), np.unique(np.concatenate([runs[w] for w in known]))] += 1
    n_one = int(y[fit].sum())
    tables = [_contrast(c[1], c[0], n_one, len(fit) - n_one) for c in (counts, by_run)]
    inputs = Inputs(*tables)

    def init(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"wa": init(2 * hidden, attention), "va": init(attention), "wo": init(2 * hidden), "bo": np.zeros(1, np.float32)}
    for s in "fb":
        p |= {"w" + s: init(WIDTH, 3 * hidden), "u" + s: init(hidden, 3 * hidden), "b" + s: np.zeros(3 * hidden, np.float32)}
    net = Network(inputs, hidden, p)
    batch = int(np.clip(len(fit) // 18, 16, batch))  # few rows still make enough steps

    x = inputs.vectors(found)
    ids, of = windows(numbers)
    first = np.concatenate([[0], x[:, 0] + x[:, 1]])[ids].max(axis=1)  # worst windows before anything is learned
    weight = np.where(y[fit] == 1, 0.5 / y[fit].mean(), 0.5 / (1 - y[fit].mean())).astype(np.float32)
    moment, square, n_steps = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for turn in range(rounds):
        if turn:
            gates = {s: net.project(x, s) for s in "fb"}
            first = np.concatenate([net.logits(gates, ids[i:i + 4096]) for i in range(0, len(ids), 4096)])
        order = np.lexsort((first, of))
        worst = order[np.append(of[order][1:] != of[order][:-1], True)]  # of each text, in the order of texts
        for part in np.array_split(rng.permutation(len(fit)), max(1, len(fit) // batch)):
            used, local = np.unique(ids[worst[part]], return_inverse=True)
            local = local.reshape(len(part), -1)
            if used[0]:
                local = local + 1  # 0 stays the empty place
            g = net.gradient(x[used[used > 0] - 1], local, y[fit][part], weight[part])
            n_steps += 1
            for k, v in p.items():
                moment[k] = 0.9 * moment[k] + 0.1 * g[k]
                square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
                scale = np.sqrt(square[k] / (1 - 0.99**n_steps)) + 1e-8
                v -= (step * moment[k] / (1 - 0.9**n_steps) / scale).astype(np.float32)
    net.shift = _level(net, texts, y, held if y[held].any() and not y[held].all() else ~held)
    net.rows.clear()
    net.cached.clear()
    return net


def _level(net: Network, texts: list[str | None], y: np.ndarray, rows: np.ndarray) -> float:
    """Logit that parts the classes with the greatest F1, halfway between its neighbours."""
    z = net.document_logits([texts[n] for n in np.flatnonzero(rows)])
    truth, z = y[rows][z > -np.inf], z[z > -np.inf]
    if not truth.any():
        return 0.0
    order = np.argsort(-z, kind="stable")
    hits = truth[order].cumsum()
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + truth.sum())
    f1[:-1][z[order][1:] == z[order][:-1]] = 0
    best = int(f1.argmax())
    return float((z[order][best] + z[order][best + 1]) / 2) if best + 1 < len(z) else float(z[order][best] - 1)


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows whose labels are never learned from: crc32 of the id's text leaves no remainder."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def training_sample(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, positives: int, negatives: int, longest: int,
) -> DataFrame:
    """(text, label) of the bounded sample; ids are chosen before any text is read."""
    known = labels.where(~held_out(F.col(key)) & F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(
        F.col(key).alias("_id")).agg(F.max(label).alias("_label"))
    sized = docs.where(F.length(text) <= longest).select(F.col(key).alias("_id")).distinct()
    known = known.join(sized, "_id", "left_semi").withColumn("_h", F.xxhash64("_id"))
    parts = [known.where(F.col("_label") == c).orderBy("_h", "_id").limit(n) for c, n in ((1, positives), (0, negatives))]
    chosen = parts[0].unionByName(parts[1])  # bounded by both limits
    return docs.where(F.length(text) <= longest).join(F.broadcast(chosen), F.col(key) == F.col("_id")).select(
        "_h", F.col(text).alias("_text"), "_label")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    positives: int = 1500, negatives: int = 3000, longest: int = 20_000,
) -> Network | float:
    """A trained network, or the share of class 1 if it cannot be trained."""
    rows = training_sample(docs, labels, key, text, label, positives, negatives, longest).toPandas()
    rows = rows.sort_values(["_h", "_text"], kind="stable")
    y = rows["_label"].to_numpy(np.float32)
    net = train(rows["_text"].tolist(), y) if len(y) else None
    return net or (float(y.mean()) if len(y) else 0.0)


def score_column(text: Column, model: Network | float) -> Column:
    if isinstance(model, float):
        return F.when(F.coalesce(text, F.lit("")).rlike(r"(?U)\w"), F.lit(model)).otherwise(F.lit(0.0))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()), pa.float64())

    return score(text)


def score_documents(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
) -> DataFrame:
    """One row per document: key, held_out, score."""
    d = with_text_batches(docs).select(F.col(key).alias(key), F.col(text).cast("string").alias("_text"))
    model = fit_toxicity(d, labels, key, "_text", label)
    return d.select(key, held_out(F.col(key)).alias("held_out"), score_column(F.col("_text"), model).alias("score"))

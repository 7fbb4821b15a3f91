"""Words of many texts at once, from their bytes: places and 64-bit hashes in numpy, without a step per word.

Words are runs of bytes other than ASCII white space, A-Z in lower case.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

U = np.uint64
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
STRETCH = 1 << 20  # bytes hashed at a time
RUN = 1 << 16  # bytes of distinct words hashed at a time
SLICE = 1 << 21  # bytes of text held at a time
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(of: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, U(of))]))


def run_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of ``values[first:last]`` for each pair: a polynomial from prefix sums; BASE is odd, so its powers divide."""
    sums = np.concatenate([[U(0)], np.cumsum(values * powers(BASE, len(values))[:-1], dtype=U)])
    return mixed((sums[last] - sums[first]) * powers(BASE_INVERSE, len(values))[first] + (last - first).astype(U))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words in bytes, the places of their first bytes and the places behind their last."""
    hashes, starts, ends, a = [], [], [], 0
    while a < len(data):
        b = min(a + STRETCH, len(data))
        if b < len(data):  # end at white space; a word longer than the stretch is taken whole
            gaps = np.flatnonzero(WHITE[data[a:b]])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                while b < len(data) and not WHITE[data[b]]:
                    b += 1
        part = LOWER[data[a:b]]
        inside = np.concatenate([[False], ~WHITE[part], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        hashes.append(run_hashes(part.astype(U) + U(1), first, last))
        starts.append(first + a)
        ends.append(last + a)
        a = b
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def distinct_words(data: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """The distinct words in bytes, for each word its number among them, and the places behind the words' last bytes."""
    white = WHITE[data]
    edged = np.concatenate([[True], white, [True]])
    edges = np.flatnonzero(edged[1:] != edged[:-1])
    first, last = edges[::2], edges[1::2]
    places = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    every = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(LOWER[data[~white]])])
    coded = every.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), last


def hashes_of(words: pa.BinaryArray) -> np.ndarray:
    """Hash of each word, the one that :func:`words_of` gives."""
    if not len(words):
        return np.zeros(0, U)
    _, places, data = words.buffers()
    places = np.frombuffer(places, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out, i = np.empty(len(words), U), 0
    while i < len(words):  # runs of words of a bounded size, so that sums stay in the cache; a longer word alone
        j = max(i + 1, int(np.searchsorted(places, places[i] + RUN, side="right")) - 1)
        at = places[i:j + 1] - places[i]
        out[i:j] = run_hashes(values[places[i]:places[j]].astype(U) + U(1), at[:-1], at[1:])
        i = j
    return out


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, ends): runs of texts of about SLICE bytes, a longer text alone.

    Texts stand one behind the other with a line end after each; ``ends`` are the places behind those; null is empty.
    """
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary())
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(lengths) - lengths) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        data = b"".join((t or b"") + b"\n" for t in texts.slice(a, b - a).to_pylist())
        yield a, b, np.frombuffer(data, np.uint8), np.cumsum(lengths[a:b] + 1)

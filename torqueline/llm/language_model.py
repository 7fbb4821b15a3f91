"""N-gram language model in a log-frequency Bloom filter.

Counts of the n-grams (up to ``order`` tokens) of the training texts are quantised on a logarithmic scale: a count c
has the level 1 + floor(log2(c)), and the filter holds the n-gram once for each level up to its own.  A count is read
back by membership probes at rising levels until one fails, as the middle of the counts of the last level met.
Probabilities are smoothed from such counts: each order adds ``mass`` pseudo-counts, dealt by the order below; the
lowest order is the additive one.  A count is never taken as more than that of the n-gram without its first or
without its last token, so probabilities stay below one.

How it scales.  Texts are hashed in numpy, in tasks.  N-grams go out as packed hashes and counts by segment of
the hash space, pre-aggregated per batch; the segments' number follows the number of tokens, so a segment is a few
hundred kilobytes, and a task builds its part of the filter alone.  The filter grows with the distinct n-grams.  Up to
``block_bytes`` it is broadcast.  A larger one stays where it is: texts are bundled in packs, the distinct n-grams of a
pack go to their segments as hashes, and their levels come back to the pack (a byte each), so a text is read as often
however large the filter.

The base score is exact: tokens are counted as strings; those with at least ``often`` of all tokens are at most
1 / often, and are broadcast.  The rest go out packed like the n-grams, each word once a pack of texts, and meet the
vocabulary in buckets of their hash, as strings; their counts go back to the pack.  Logarithms are summed as whole
numbers, so the sum does not depend on the order of rows.

Defined results: null text has no words, only the end; a null id is held out like the empty string; without training
rows all counts are zero; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from torqueline.llm.base import with_text_batches
from torqueline.llm.wordbytes import U, distinct_words, hashes_of, mixed, text_slices
from torqueline.session import scratch, scratch_path, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

START_MARK, END_MARK = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
LONG_WORD = 64  # bytes; longer words are named by their digest
PER_SEGMENT = 1 << 18  # n-grams
PACK = 1 << 21  # n-grams that a task gathers before it sends them out
PROBED = 1 << 15  # n-grams probed together
RARE_PACK = 1 << 20  # occurrences of rare words, or words of the vocabulary, likewise
BUNDLE = 1 << 22  # bytes of text whose n-grams are looked up together where the filter is too large to broadcast
# Rows of megabytes: a few in a row group, or Parquet holds many of them when it writes, and all of a group when it reads.
WIDE_ROWS = {"parquet.block.size": str(2 * BUNDLE), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
RARE_PARTS = {"pack": pa.int64(), "bucket": pa.int32(), "names": pa.binary(), "at": pa.binary(), "rows": pa.binary()}


def held_out(key: Column, folds: int = 10) -> Column:
    """Rows that are never learned from: crc32 of the id's text leaves no remainder."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.BinaryArray, np.ndarray]]:
    """(from, to, tokens, sizes, names, which): runs of texts of bounded size, a longer text alone.

    ``tokens`` are the texts' word hashes, each text between a start and an end mark; ``sizes`` count the marks.
    ``names`` are the distinct words and, last, the end as the empty name; ``which`` is each token's place there, the
    start's behind it.
    """
    for a, b, data, behind in text_slices(texts):
        words, coded, ends = distinct_words(data)
        upto = np.searchsorted(ends, behind, side="left")
        sizes = np.diff(np.concatenate([[0], upto])) + 2
        which = np.empty(int(sizes.sum()), np.int64)
        stops = np.cumsum(sizes)
        inside = np.ones(len(which), bool)
        inside[stops - sizes], inside[stops - 1] = False, False
        which[stops - sizes], which[stops - 1], which[inside] = len(words) + 1, len(words), coded
        tokens = np.concatenate([hashes_of(words), [END_MARK, START_MARK]])[which]
        yield a, b, tokens, sizes, pa.concat_arrays([words, pa.array([b""], pa.binary())]), which


def ngrams(tokens: np.ndarray, sizes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, present) by length 1 to ``order`` for the n-gram that ends at each token, within its text."""
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out, now = [(mixed(tokens + U(1)), np.ones(len(tokens), bool))], tokens
    for n in range(2, order + 1):
        now = np.concatenate([[U(0)], mixed(now[:-1])]) + tokens * U(0xD1342543DE82EF95)
        out.append((mixed(now + U(n)), at >= n - 1))
    return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(counts)).astype(np.int64) + 1


def middle(levels: np.ndarray) -> np.ndarray:
    """Mean of the counts of a level, 0 for level 0."""
    return np.where(levels > 0, (2.0 ** (levels - 1) + 2.0 ** levels - 1) / 2, 0.0)


def places(hashes: np.ndarray, level: int, bits: np.ndarray, probes: int) -> Iterator[Callable[[slice | np.ndarray], np.ndarray]]:
    """For each probe, the bits of chosen n-grams at a level; two hashes give all probes, and a product replaces a modulo."""
    first = mixed(hashes + U(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    step = mixed(first) | U(1)
    for probe in range(probes):
        yield lambda which, probe=probe: ((((first[which] + U(probe) * step[which]) >> U(32)) * bits[which]) >> U(32)).astype(np.int64)


class Filter:
    """A block of the filter: segments one behind the other."""

    def __init__(self, first: int, sizes: np.ndarray, segments: int, probes: int):
        self.first, self.segments, self.probes = first, segments, probes
        self.bits = sizes * 8
        self.offsets = (np.cumsum(sizes) - sizes) * 8
        self.data = np.zeros(int(sizes.sum()), np.uint8)

    def put(self, segment: int, data: bytes) -> None:
        at = self.offsets[segment - self.first] // 8
        self.data[at:at + len(data)] = np.frombuffer(data, np.uint8)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Highest level met from level 1 on without a gap; 0 for n-grams of other blocks."""
        # each n-gram once, in the order of the segments
        hashes, back = np.unique(hashes, return_inverse=True)
        found = np.zeros(len(hashes), np.uint8)
        segment = segment_of(hashes, self.segments) - self.first
        here = np.flatnonzero((segment >= 0) & (segment < len(self.bits)))
        here = here[self.bits[segment[here]] > 0]
        level = 1
        while len(here):
            # runs of a bounded number, so that their numbers stay in the cache
            runs = [here[a:a + PROBED] for a in range(0, len(here), PROBED)]
            here = np.concatenate([run[self._met(hashes[run], segment[run], level)] for run in runs])
            found[here] = level
            level += 1
        return found[back]

    def _met(self, hashes: np.ndarray, segment: np.ndarray, level: int) -> np.ndarray:
        """Places of the n-grams of which all bits at a level are set; those that failed are left behind once they are many."""
        every, begins = np.arange(len(hashes)), self.offsets[segment]
        left, alive = slice(None), np.ones(len(hashes), bool)
        for at in places(hashes, level, self.bits[segment].astype(U), self.probes):
            bit = at(left) + begins[left]
            alive &= ((self.data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).view(bool)
            if np.count_nonzero(alive) < 0.8 * len(alive):
                left = every[left][alive]
                alive = np.ones(len(left), bool)
        return every[left][alive]


def segment_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (((hashes >> U(32)) * U(segments)) >> U(32)).astype(np.int64)


def built(hashes: np.ndarray, counts: np.ndarray, bits_each: float, probes: int) -> bytes:
    """The filter of one segment."""
    levels = levels_of(counts)
    bits = max(64, -(-int(levels.sum() * bits_each) // 8) * 8)
    data = np.zeros(bits // 8, np.uint8)
    for level in range(1, int(levels.max()) + 1):
        left = hashes[levels >= level]
        for place in places(left, level, np.full(len(left), bits, U), probes):
            at = place(slice(None))
            np.bitwise_or.at(data, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return data.tobytes()


def _digested(names: pa.BinaryArray) -> pa.BinaryArray:
    """The names, those over LONG_WORD bytes by their digest, which is over it as well, so no other word is spelled so."""
    from hashlib import sha256

    long = np.flatnonzero(pc.binary_length(names).to_numpy() > LONG_WORD)
    if not len(long):
        return names
    mask = np.zeros(len(names), bool)
    mask[long] = True
    digests = [b"\0" + sha256(w.as_py()).hexdigest().encode() for w in names.take(pa.array(long))]
    return pc.replace_with_mask(names, pa.array(mask), pa.array(digests, pa.binary()))


def _summed(held: list[tuple[pa.BinaryArray, np.ndarray]]) -> tuple[pa.BinaryArray, np.ndarray]:
    """Each name once, with the sum of its counts."""
    coded = pa.concat_arrays([names for names, _ in held]).dictionary_encode()
    sums = np.zeros(len(coded.dictionary), np.int64)
    np.add.at(sums, coded.indices.to_numpy(), np.concatenate([counts for _, counts in held]))
    return coded.dictionary, sums


def vocabulary(train: DataFrame, text: str = "text", flush: int = 1 << 18) -> DataFrame:
    """(word, c): how often each token stands in the training texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.BinaryArray, np.ndarray]] = []
        waiting = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([held[0][0], pa.array(held[0][1])], names=["word", "c"])

        for batch in batches:
            for *_, names, which in slices(batch.column(0)):
                held.append((_digested(names), np.bincount(which, minlength=len(names) + 1)[:-1]))
                waiting += len(names)
                if waiting > 2 * flush:
                    held = [_summed(held)]
                    if (waiting := len(held[0][0])) > flush:
                        yield out()
                        held, waiting = [], 0
        if held:
            held = [_summed(held)]
            yield out()

    words = with_text_batches(train).select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word binary, c long")
    return words.groupBy("word").agg(F.sum("c").alias("c"))


class Frequent:
    """The words with many occurrences and the logarithms of their counts, found by hash and compared as words."""

    def __init__(self, words: list[bytes], counts: list[int]):
        names = pa.array(words, pa.binary())
        hashes = hashes_of(names)
        order = np.argsort(hashes)
        self.hashes, self.names = hashes[order], names.take(pa.array(order))
        self.units = units_of(np.array(counts, np.int64))[order]

    def of(self, names: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(found, units) by name; a word that another one hides counts as rare."""
        if not len(self.hashes):
            return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        hashes = hashes_of(names)
        at = np.searchsorted(self.hashes, hashes).clip(max=len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        maybe = np.flatnonzero(found)
        found[maybe] = pc.equal(names.take(pa.array(maybe)), self.names.take(pa.array(at[maybe]))).to_numpy(zero_copy_only=False)
        return found, np.where(found, self.units[at], 0)


def units_of(counts: np.ndarray) -> np.ndarray:
    """Logarithms of raised counts, as whole numbers of 1e-12, whose sums do not depend on their order."""
    return np.rint(np.log10(counts + 0.1) * 1e12).astype(np.int64)


def sums_by_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    stops = np.cumsum(sizes)
    return upto[stops] - upto[stops - sizes]


def whole_sums(units: np.ndarray, sizes: np.ndarray) -> list[Decimal]:
    """Sums of units by text; in two halves, since a million logarithms of 1e13 units exceed 64 bits."""
    high, low = sums_by_text(units >> 24, sizes), sums_by_text(units & (1 << 24) - 1, sizes)
    return [Decimal((h << 24) + x) for h, x in zip(high.tolist(), low.tolist(), strict=True)]


def by_bucket(names: pa.BinaryArray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the names by their bucket, the buckets that are not empty, and where each begins and the last ends."""
    bucket = segment_of(hashes_of(names), buckets)
    order = np.argsort(bucket, kind="stable")
    full, begins = np.unique(bucket[order], return_index=True)
    return order, full, np.append(begins, len(names))


def joined(names: pa.BinaryArray, cuts: np.ndarray) -> pa.BinaryArray:
    """One value of the names between each two cuts; names hold no white space, so a line end parts them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), names), b"\n")


def parted(values: pa.BinaryArray) -> pa.ListArray:
    return pc.split_pattern(values, "\n")


class Rare:
    """Occurrences of rare words in consecutive rows, packed: the words by bucket, and (word, row) pairs."""

    def __init__(self, first: int, buckets: int):
        self.first, self.buckets = first, buckets
        self.names: list[pa.BinaryArray] = []
        self.at: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.named = self.waiting = 0

    def add(self, names: pa.BinaryArray, found: np.ndarray, which: np.ndarray, rows: np.ndarray) -> None:
        left = np.flatnonzero(~found[:-1])
        place = np.full(len(names) + 1, -1)
        place[left] = np.arange(len(left)) + self.named
        at = place[which]
        keep = at >= 0
        self.names.append(names.take(pa.array(left)))
        self.at.append(at[keep])
        self.rows.append(rows[keep])
        self.named += len(left)
        self.waiting += int(keep.sum())

    def full(self) -> bool:
        return self.waiting >= RARE_PACK

    def packed(self) -> list[pa.Array]:
        """Columns of RARE_PARTS: a row of words per bucket, and one row, of no bucket, of the pairs.

        Pairs number the words in the order of the buckets, and the rows from the first.
        """
        coded = pa.concat_arrays(self.names).dictionary_encode()
        order, full, cuts = by_bucket(coded.dictionary, self.buckets)
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order))
        at = place[coded.indices.to_numpy()[np.concatenate(self.at)]]
        rows, n = np.concatenate(self.rows) - self.first, len(full)
        return [
            pa.array(np.full(n + 1, self.first)), pa.array([*full.tolist(), None], pa.int32()),
            pa.concat_arrays([joined(coded.dictionary.take(pa.array(order)), cuts), pa.nulls(1, pa.binary())]),
            pa.array([None] * n + [at.tobytes()], pa.binary()), pa.array([None] * n + [rows.astype("<u4").tobytes()], pa.binary())]


def _rare_sums(packs: DataFrame, vocab: DataFrame, buckets: int) -> DataFrame:
    """(row, more, met): the sum of the rare words' logarithms and the number of those that are known.

    The words of a pack meet the vocabulary in their bucket, as words; their counts go back to the pack.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            names, counts = pa.concat_arrays([n for n, _ in held]), np.concatenate([c for _, c in held])
            order, full, cuts = by_bucket(names, buckets)
            counts = counts[order].astype("<i8")
            return pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), joined(names.take(pa.array(order)), cuts),
                pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["bucket", "names", "counts"])

        held = []
        for batch in batches:
            held.append((batch.column(0), batch.column(1).to_numpy()))
            if sum(len(n) for n, _ in held) >= RARE_PACK:
                yield out()
                held = []
        if sum(len(n) for n, _ in held):
            yield out()

    def answer(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        there = known.column("names").combine_chunks()
        lists = parted(asked.column("names").combine_chunks())
        counts = np.frombuffer(b"".join(known.column("counts").to_pylist()), "<i8")
        found = pc.index_in(lists.flatten(), value_set=parted(there).flatten()).fill_null(len(counts)).to_numpy()
        cuts = np.asarray(lists.offsets)
        c = np.append(counts, 0)[found].astype("<i8")
        return pa.table({
            "pack": asked.column("pack"), "bucket": asked.column("bucket"),
            "counts": pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    def back(key: tuple, pairs: pa.Table, counted: pa.Table) -> pa.Table:
        counted = counted.sort_by("bucket")
        c = np.frombuffer(b"".join(counted.column("counts").to_pylist()), "<i8")
        at, rows = (np.frombuffer(pairs.column(x)[0].as_py(), "<u4") for x in ("at", "rows"))
        # pairs stand in the order of the rows
        begins = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        sizes = np.diff(np.append(begins, len(rows)))
        return pa.table({
            "row": pa.array(rows[begins].astype(np.int64) + key[0].as_py()),
            "more": pa.array(whole_sums(units_of(c)[at], sizes), pa.decimal128(38, 0)), "met": pa.array(sums_by_text(c[at] > 0, sizes))})

    known = vocab.select("word", "c").mapInArrow(pack, "bucket int, names binary, counts binary")
    asked = packs.where(F.col("bucket").isNotNull()).select("pack", "bucket", "names")
    counted = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, "pack long, bucket int, counts binary")
    pairs = packs.where(F.col("bucket").isNull()).select("pack", "at", "rows")
    return pairs.groupBy("pack").cogroup(counted.groupBy("pack")).applyInArrow(back, "row long, more decimal(38,0), met long")


def _packed(train: DataFrame, text: str, order: int, segments: int) -> DataFrame:
    """(segment, hashes, counts): packed n-grams of a slice of training texts."""
    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(segment_of(hashes, segments), np.arange(segments + 1))
        full = np.flatnonzero(np.diff(cuts))
        counts = counts.astype("<u4")
        return pa.RecordBatch.from_arrays([
            pa.array(full, pa.int32()), pa.array([hashes[cuts[i]:cuts[i + 1]].tobytes() for i in full], pa.binary()),
            pa.array([counts[cuts[i]:cuts[i + 1]].tobytes() for i in full], pa.binary())], names=["segment", "hashes", "counts"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for _, _, tokens, sizes, *_ in slices(batch.column(0)):
                held += [h[p] for h, p in ngrams(tokens, sizes, order)]
                if sum(map(len, held)) >= PACK:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return with_text_batches(train).select(F.col(text).cast("string").alias("text")).mapInArrow(pack, "segment int, hashes binary, counts binary")


def fitted(train: DataFrame, text: str, tokens: int, order: int, bits_each: float, probes: int) -> tuple[DataFrame, int]:
    """(segment, data) of the filter, one row per segment, and the number of segments."""
    segments = max(1, -(-tokens * order // PER_SEGMENT))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(b, "<u8") for b in frame["hashes"]])
        counts = np.concatenate([np.frombuffer(b, "<u4") for b in frame["counts"]]).astype(np.int64)
        order_ = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order_], counts[order_]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        return pd.DataFrame({"segment": [frame["segment"].iloc[0]], "data": [built(hashes[first], np.add.reduceat(counts, first), bits_each, probes)]})

    parts = _packed(train, text, order, segments).groupBy("segment").applyInPandas(build, "segment int, data binary")
    return settle(parts, "filter"), segments


def probabilities(levels: list[np.ndarray], present: list[np.ndarray], sizes: np.ndarray, train_tokens: int, distinct: int,
                  mass: float, least: float = 0.1) -> np.ndarray:
    """log10 probability of each text from the levels of its n-grams by length; the start is not scored."""
    counts = [middle(x.astype(np.int64)) for x in levels]
    p = (np.minimum(counts[0], train_tokens) + least) / (train_tokens + least * (distinct + 1))
    for n in range(1, len(counts)):
        before = np.concatenate([[0.0], counts[n - 1][:-1]])
        both = np.minimum(np.minimum(counts[n], counts[n - 1]), before)
        counts[n] = both
        p = np.where(present[n], (both + mass * p) / (before + mass), p)
    logs = np.log10(p)
    stops = np.cumsum(sizes)
    logs[stops - sizes] = 0.0
    return np.add.reduceat(logs, stops - sizes) if len(sizes) else np.zeros(0)


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10, order: int = 2, mass: float = 5.0,
                    bits_each: float = 10.0, probes: int = 4, block_bytes: int = 256 << 20, often: float = 2e-6) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    d = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), held_out(F.col(key), folds).alias("held"))
    train = d.where(~F.col("held")).select("text")
    vocab = settle(vocabulary(train), "vocabulary")
    total = vocab.agg(F.sum("c"), F.count("*")).first()
    train_tokens, distinct = int(total[0] or 0), int(total[1])
    floor = train_tokens + 0.1 * (distinct + 1)

    parts, segments = fitted(train, "text", max(train_tokens, 1), order, bits_each, probes)
    # at most 1 / often words, each of at most LONG_WORD + 1 bytes
    known = list(vocab.where((F.col("c") >= max(often * train_tokens, 1)) & F.lit(often > 0)).toLocalIterator())
    words = d.sparkSession.sparkContext.broadcast(Frequent([bytes(r[0]) for r in known], [r[1] for r in known]))
    buckets = max(1, train_tokens // (4 * PER_SEGMENT))

    columns = ["id", "held", "n_tokens", "known", "units", "score", "row", *RARE_PARTS]

    def out(packed: list[pa.Array], ids: pa.DataType) -> pa.RecordBatch:
        types = [ids, pa.bool_(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(packed[0]), t) for t in types], *packed], names=columns)

    def score(batches: Iterator[pa.RecordBatch], row: int, read: Callable) -> Iterator[pa.RecordBatch]:
        """Scores of rows numbered from ``row``, and their rare words; ``read`` gives slices, n-grams and levels of texts."""
        frequent, rare = words.value, Rare(row, buckets)
        for batch in batches:
            ids = batch.column(0).type
            scores, known_ = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            n_tokens, units = np.zeros(batch.num_rows, np.int64), []
            for (a, b, _, sizes, names, which), grams, levels in read(batch.column(1)):
                scores[a:b] = probabilities(levels, [p for _, p in grams], sizes, train_tokens, distinct, mass)
                names = _digested(names)
                found, unit = frequent.of(names)
                # the start has no name
                found, unit = np.append(found, False), np.append(unit, 0)
                n_tokens[a:b], known_[a:b] = sizes - 1, sums_by_text(found[which], sizes)
                units += whole_sums(unit[which], sizes)
                rare.add(names, found, which, np.repeat(row + np.arange(a, b), sizes))
                if rare.full():
                    yield out(rare.packed(), ids)
                    rare = Rare(row + b, buckets)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(n_tokens), pa.array(known_), pa.array(units, pa.decimal128(38, 0)), pa.array(scores),
                pa.array(row + np.arange(n)), *[pa.nulls(n, t) for t in RARE_PARTS.values()]], names=columns)
            row += n
        if rare.waiting:
            yield out(rare.packed(), ids)

    kind = docs.schema[key].dataType.simpleString()
    shape = (f"id {kind}, held boolean, n_tokens long, known long, units decimal(38,0), score double, row long, "
             "pack long, bucket int, names binary, at binary, rows binary")
    d, path = with_text_batches(d).select("id", "text", "held"), scratch_path(d.sparkSession, "scored")
    if len(blocks := list_of_blocks(parts, segments, block_bytes)) == 1:
        block = _broadcast_block(parts, blocks[0], segments, probes)

        def probed(texts: pa.Array) -> Iterator[tuple]:
            for one in slices(texts):
                grams = ngrams(one[2], one[3], order)
                yield one, grams, [np.where(present, block.value.levels(h), 0) for h, present in grams]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from score(batches, TaskContext.get().partitionId() << 33, probed)

        scored = settle(d.mapInArrow(rows, shape), "scored", path)
    else:
        def pack_rows(key: tuple, pack: pa.Table, answers: pa.Table) -> pa.Table:
            levels = np.frombuffer(b"".join(answers.sort_by("segment").column("levels").to_pylist()), np.uint8)
            batch = pa.RecordBatch.from_arrays([pack.column(c)[0].values for c in ("ids", "texts", "held")], names=["id", "text", "held"])
            return pa.Table.from_batches(list(score([batch], key[0].as_py(), lambda texts: _answered(texts, order, levels))))

        with scratch(d.sparkSession):
            packs = settle(_bundled(d, kind), "packs", options=WIDE_ROWS)
            answers = settle(_answers(packs, parts, order, segments, probes), "answers")
            scored = settle(packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(pack_rows, shape), "scored", path)
    more = _rare_sums(scored.where(F.col("pack").isNotNull()), vocab, buckets)
    docs_ = scored.where(F.col("pack").isNull()).drop(*RARE_PARTS).join(more, "row", "left")
    units = F.col("units") + F.coalesce("more", F.lit(0).cast("decimal(38,0)"))
    return docs_.select(
        F.col("id").alias(key), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (units.cast("double") / 1e12 - F.col("n_tokens") * F.lit(math.log10(floor))).alias("base_score"), "score")


def list_of_blocks(parts: DataFrame, segments: int, block_bytes: int) -> list[tuple[int, int]]:
    """Runs of segments whose data are at most ``block_bytes`` together (one segment at least)."""
    sizes = dict(parts.select("segment", F.length("data")).toLocalIterator())  # two numbers a segment
    runs, first, held = [], 0, 0
    for i in range(segments):
        if i > first and held + sizes.get(i, 0) > block_bytes:
            runs.append((first, i))
            first, held = i, 0
        held += sizes.get(i, 0)
    return [*runs, (first, segments)]


def _broadcast_block(parts: DataFrame, span: tuple[int, int], segments: int, probes: int):
    rows = parts.where(F.col("segment").between(span[0], span[1] - 1))
    sizes = np.zeros(span[1] - span[0], np.int64)
    for i, n in rows.select("segment", F.length("data")).toLocalIterator():
        sizes[i - span[0]] = n
    block = Filter(span[0], sizes, segments, probes)
    for i, data in rows.toLocalIterator():
        block.put(i, data)
    return parts.sparkSession.sparkContext.broadcast(block)


def _bundled(docs: DataFrame, kind: str) -> DataFrame:
    """(pack, ids, texts, held): consecutive rows of about BUNDLE bytes of text as one, a pack named by the number of its first row."""
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, row = 0, TaskContext.get().partitionId() << 33

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), c.combine_chunks()) for c in rows.columns]
            return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *lists], names=["pack", "ids", "texts", "held"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            run = (np.cumsum(lengths) - lengths) // BUNDLE
            cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(lengths)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                held.append(batch.slice(a, b - a))
                size += int(lengths[a:b].sum())
                if size >= BUNDLE:
                    yield out()
                    row += sum(len(x) for x in held)
                    held, size = [], 0
        if sum(len(x) for x in held):
            yield out()

    return docs.mapInArrow(bundle, f"pack long, ids array<{kind}>, texts array<string>, held array<boolean>")


def _answers(packs: DataFrame, parts: DataFrame, order: int, segments: int, probes: int) -> DataFrame:
    """(pack, segment, levels): the levels of a pack's distinct n-grams, in the order of their hashes, by the filter's segments."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = np.unique(np.concatenate([h[p] for one in slices(texts.values) for h, p in ngrams(one[2], one[3], order)]))
                full, begins = np.unique(segment_of(hashes, segments), return_index=True)
                sent = [x.tobytes() for x in np.split(hashes, begins[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), pack)), pa.array(full, pa.int32()), pa.array(sent, pa.binary())],
                                                 names=["pack", "segment", "hashes"])

    def answer(key: tuple, asked: pa.Table, part: pa.Table) -> pa.Table:
        sent = asked.column("hashes").to_pylist()
        hashes = np.frombuffer(b"".join(sent), "<u8")
        levels = np.zeros(len(hashes), np.uint8)
        if len(part):  # else no n-gram of this segment was learned
            data = part.column("data")[0].as_py()
            segment = Filter(key[0].as_py(), np.array([len(data)]), segments, probes)
            segment.put(segment.first, data)
            levels = segment.levels(hashes)
        stops = np.cumsum([len(x) // 8 for x in sent], dtype=np.int64)
        found = [levels[a:b].tobytes() for a, b in zip([0, *stops[:-1]], stops, strict=True)] if sent else []
        return pa.table({"pack": asked.column("pack"), "segment": asked.column("segment"), "levels": pa.array(found, pa.binary())})

    asked = packs.select("pack", "texts").mapInArrow(ask, "pack long, segment int, hashes binary")
    return asked.groupBy("segment").cogroup(parts.groupBy("segment")).applyInArrow(answer, "pack long, segment int, levels binary")


def _answered(texts: pa.Array, order: int, levels: np.ndarray) -> Iterator[tuple]:
    """(slice, n-grams, levels by length) of a pack's texts from the levels of its distinct n-grams."""
    read = [(one, ngrams(one[2], one[3], order)) for one in slices(texts)]
    hashes, back = np.unique(np.concatenate([h[p] for _, grams in read for h, p in grams]), return_inverse=True)
    if len(hashes) != len(levels):
        raise ValueError("a pack's n-grams and their answers differ")
    every, at = levels[back], 0
    for one, grams in read:
        out = [np.zeros(len(p), np.uint8) for _, p in grams]
        for x, (_, p) in zip(out, grams, strict=True):
            n = int(p.sum())
            x[p] = every[at:at + n]
            at += n
        yield one, grams, out

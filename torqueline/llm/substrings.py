"""Substring deduplication by sliding sentence spans.

A text is cut after sentences and line ends.  Sentences of at least ``LONG`` words are cut further, at points that the
words alone set: places whose word triple has the least hash of ``NEAR`` neighbouring places.  From every cut on,
the shortest run of at least ``run`` pieces and ``least_words`` words is a span.  Cuts depend on the words around
them only, and no two are ``LONG`` words apart or more, so of 50 shared words all but the first and last ``LONG`` - 1 are cut
alike, whatever stands around them, and hold a whole span (for ``run`` 3 and ``least_words`` 15).

Spans are hashed to 96 bits, after white space and ASCII case, and met over the whole corpus; a span that occurs
more than once keeps its first place, by id and piece, and every piece that any other place covers is removed.

How it scales.  All words of a batch of texts are cut and hashed together in numpy.  Hashes and places go out packed,
by segment of the hash space; a segment is met in one task and holds some hundred thousand spans.  Of the places of one
hash among about a million spans a task sends only the first on, so a passage in a third of all documents is a few
places.  Texts are shuffled once, at the end.

Defined results: null text stays null, empty text stays empty.  Rows of one id and text are one document and are
treated alike.  Null ids come last in the order.  Texts without a repeated span come back unchanged, byte
for byte.  An empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torqueline.llm.base import with_text_batches
from torqueline.llm.grams import text_print
from torqueline.llm.wordbytes import U, mixed, run_hashes, text_slices, words_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONG, NEAR = 9, 8
PER_SEGMENT = 1 << 17  # spans
PACK = 1 << 20  # spans that a task gathers before it sends them out
BYTES_PER_SPAN = 25  # of prose, to set the number of segments
ENDING, QUOTES = np.zeros(256, bool), np.zeros(256, bool)
ENDING[list(b".!?")] = True
QUOTES[list(b"\"')]")] = True


@dataclass(frozen=True)
class Cut:
    """Pieces and spans of texts that stand one behind the other.

    ``pieces`` are the places where pieces begin, with the end of the last text behind them; ``first`` is the number of
    each text's first piece, ``text`` each span's text, ``a`` and ``b`` its first piece and the one behind its last.
    """

    pieces: np.ndarray
    first: np.ndarray
    text: np.ndarray
    a: np.ndarray
    b: np.ndarray
    h: np.ndarray
    g: np.ndarray


def points(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Which words begin a triple with the least hash, the last of equals, of NEAR neighbouring places of their text."""
    n = len(hashes)
    if n < 3:
        return np.zeros(n, bool)
    triple = mixed(hashes[:-2] * U(0x9E3779B97F4A7C15) ^ mixed(hashes[1:-1]) * U(0xD6E8FEB86659FD93) ^ hashes[2:])
    whole = text[:-2] == text[2:]
    # texts are kept apart by places that never are least
    at = np.arange(n - 2) + (text[:-2] + 1) * NEAR
    spread = np.full(n + (texts + 1) * NEAR, np.iinfo(np.uint64).max, U)
    spread[at] = np.where(whole, triple, np.iinfo(np.uint64).max)
    views = np.lib.stride_tricks.sliding_window_view(spread, NEAR)[:, ::-1]
    least = np.zeros(len(spread), bool)
    least[np.arange(NEAR - 1, len(spread)) - views.argmin(axis=1)] = True
    out = np.zeros(n, bool)
    out[:-2] = least[at] & whole
    return out


def cut_texts(data: np.ndarray, ends: np.ndarray, run: int, least_words: int) -> Cut:
    """Cut the texts in ``data``, each with a line end behind it, which ``ends`` are behind of."""
    hashes, starts, stops = words_of(data)
    n, begins = len(hashes), np.concatenate([[0], ends[:-1]])
    text = np.searchsorted(ends, starts, side="right")
    last = data[stops - 1]
    before = np.where(stops - starts > 1, data[stops - 2], 0)
    third = np.where(stops - starts > 2, data[stops - 3], 0)
    ended = ENDING[last] | (QUOTES[last] & (ENDING[before] | (QUOTES[before] & ENDING[third])))
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    following = np.append(starts[1:], len(data))
    ended |= lines[following] > lines[stops]
    opens = np.concatenate([[True], ended[:-1]]) if n else np.zeros(0, bool)
    at = np.flatnonzero(opens)
    sizes = np.diff(np.append(at, n))
    opens |= points(hashes, text, len(ends)) & np.repeat(sizes >= LONG, sizes)
    at = np.flatnonzero(opens)  # words that begin a piece
    behind = np.append(at, n)
    owner = text[at]
    upto = np.searchsorted(text, owner, side="right")  # words up to the end of the piece's text
    to = np.maximum(np.searchsorted(behind, at + least_words), np.arange(len(at)) + run)
    good = to <= len(at)
    good[good] = behind[to[good]] <= upto[good]
    a = np.flatnonzero(good)
    b = to[good]
    # a text without words is one piece, as is white space in front of its first word
    bare = np.setdiff1d(np.arange(len(ends)), owner)
    places, texts = starts[at], owner
    first_of = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    places = np.where(first_of, begins[owner], places)
    everything = np.concatenate([places, begins[bare]])
    order = np.argsort(everything, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    texts = np.concatenate([texts, bare])[order]
    first = np.searchsorted(texts, np.arange(len(ends)))
    # pieces of one text follow each other, so the one behind the last is counted from the first
    a_, span = number[a], b - a
    h = run_hashes(hashes, at[a], behind[b])
    g = run_hashes(mixed(hashes + U(0x51ED2701)), at[a], behind[b])
    return Cut(np.append(everything[order], len(data)), first, owner[a], a_ - first[owner[a]], a_ - first[owner[a]] + span,
               h.view(np.int64), (g >> U(32)).astype(np.uint32).view(np.int32))


def _one(text: str, run: int, least_words: int) -> tuple[bytes, Cut]:
    data = text.encode("utf-8", "surrogatepass") + b"\n"
    return data, cut_texts(np.frombuffer(data, np.uint8), np.array([len(data)]), run, least_words)


def sentences(text: str) -> list[str]:
    """Pieces that make up the text."""
    if not text:
        return []
    data, cut = _one(text, 1, 1)
    return [data[a:min(b, len(data) - 1)].decode("utf-8", "surrogatepass") for a, b in zip(cut.pieces[:-1].tolist(), cut.pieces[1:].tolist(), strict=True)]


def spans_of(text: str, run: int, least_words: int) -> list[tuple[int, int, bytes]]:
    """(first piece, piece after the last, 12-byte hash) of every span."""
    _, cut = _one(text, run, least_words)
    return [(a, b, np.int64(h).tobytes() + np.int32(g).tobytes()) for a, b, h, g in zip(
        cut.a.tolist(), cut.b.tolist(), cut.h.tolist(), cut.g.tolist(), strict=True)]


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return (((h.view(U) >> U(32)) * U(segments)) >> U(32)).astype(np.int32)


def _places(ids: pa.Array, prints: pa.Array) -> np.ndarray:
    """Rank of each text by id, nulls last, and print; rows of one id and text share it."""
    t = pa.table({"id": ids, "print": prints})
    order = pc.sort_indices(t, [("id", "ascending"), ("print", "ascending")], null_placement="at_end")
    t = t.take(order)
    one, two = t.slice(0, max(len(t) - 1, 0)), t.slice(1)
    out = np.zeros(len(t), np.int64)
    out[order.to_numpy()] = np.concatenate([[0], np.cumsum(~_alike(one, two, ("id", "print")).to_numpy(zero_copy_only=False))])[:len(t)]
    return out


def _alike(one: pa.Table, two: pa.Table, columns: tuple[str, ...]) -> pa.Array:
    """Row by row equality, nulls equal."""
    out = pa.array(np.ones(len(one), bool))
    for c in columns:
        x, y = one.column(c).combine_chunks(), two.column(c).combine_chunks()
        out = pc.and_(out, pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y))))
    return out


def _packed(docs: DataFrame, segments: int, run: int, least_words: int) -> DataFrame:
    """(segment, id, print, n, a, h, g, known): texts with n spans each, and the spans, in lists.

    Of the places of a hash that a task holds at a time only the first is sent; the others are known to repeat, and go
    out as rows with ``known`` to a segment that their text sets, so that a span in many texts is not one group.
    """
    kind = docs.schema["id"].dataType
    lists = [("id", kind), ("print", T.LongType()), ("n", T.IntegerType()), ("a", T.IntegerType()), ("h", T.LongType()), ("g", T.IntegerType())]
    schema = T.StructType([T.StructField("segment", T.IntegerType()), *[T.StructField(c, T.ArrayType(t)) for c, t in lists], T.StructField("known", T.BooleanType())])

    def rows(ids, prints, segment, doc, a, h, g, known: bool) -> pa.RecordBatch:
        order = np.lexsort((doc, segment))
        segment, doc = segment[order], doc[order]
        opens = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(segment) != 0)]))  # a text in a segment
        full = np.flatnonzero(np.concatenate([[True], np.diff(segment) != 0]))
        texts, spans = pa.array(np.append(np.searchsorted(opens, full), len(opens)), pa.int32()), pa.array(np.append(full, len(doc)), pa.int32())
        which, none = pa.array(doc[opens]), pa.array(np.zeros(len(full) + 1), pa.int32())
        per_text = [ids.take(which), prints.take(which), pa.array(np.diff(np.append(opens, len(doc))), pa.int32())]
        columns = [pa.array(segment[full], pa.int32()), *[pa.ListArray.from_arrays(texts, x) for x in per_text], pa.ListArray.from_arrays(spans, pa.array(a[order], pa.int32()))]
        columns += [pa.ListArray.from_arrays(none, pa.array([], t)) if known else pa.ListArray.from_arrays(spans, pa.array(x[order])) for x, t in ((h, pa.int64()), (g, pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(full), known))], names=schema.names)

    def out(ids: list, prints: list, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, prints = pa.concat_arrays(ids), pa.concat_arrays(prints)
        doc, a, h, g = (np.concatenate([x[i] for x in held]) for i in range(4))
        place = _places(ids, prints)[doc] << 32 | a
        order = np.lexsort((place, g, h))
        doc, a, h, g, place = doc[order], a[order], h[order], g[order], place[order]
        opens = np.concatenate([[True], (np.diff(h) != 0) | (np.diff(g) != 0)])
        first = place[opens][np.cumsum(opens) - 1]
        yield rows(ids, prints, segment_of(h[opens], segments), doc[opens], a[opens], h[opens], g[opens], False)
        later = place != first
        if later.any():
            doc, a = doc[later], a[later]
            by_text = segment_of(mixed(prints.to_numpy().view(U)).view(np.int64), segments)
            yield rows(ids, prints, by_text[doc], doc, a, None, None, True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, prints, held, before = [], [], [], 0
        for batch in batches:
            ids.append(batch.column(0))
            prints.append(batch.column(1))
            for a, _, data, ends in text_slices(batch.column(2)):
                cut = cut_texts(data, ends, run, least_words)
                held.append((cut.text + a + before, cut.a, cut.h, cut.g))
            before += batch.num_rows
            if sum(len(x[0]) for x in held) >= PACK:
                yield from out(ids, prints, held)
                ids, prints, held, before = [], [], [], 0
        if sum(len(x[0]) for x in held):
            yield from out(ids, prints, held)

    return docs.mapInArrow(pack, schema)


def repeated_places(docs: DataFrame, key: str, text: str, run: int = 3, least_words: int = 15) -> DataFrame:
    """(id, print, cuts): first pieces of the spans that stand at an earlier place as well, sorted."""
    d = with_text_batches(docs).select(F.col(key).alias("id"), text_print(text).alias("print"), F.col(text).cast("string").alias("t"))
    size = d.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    packed = _packed(d, max(1, -(-size // (BYTES_PER_SPAN * PER_SEGMENT))), run, least_words)
    schema = T.StructType([T.StructField("id", d.schema["id"].dataType), T.StructField("print", T.LongType()), T.StructField("a", T.IntegerType())])

    found = pa.schema([("id", _arrow_kind(d)), ("print", pa.int64()), ("a", pa.int32())])

    def flat(rows: pa.Table) -> dict[str, pa.Array]:
        out = {c: pa.chunked_array([x.flatten() for x in rows.column(c).chunks], rows.schema.field(c).type.value_type).combine_chunks() for c in ("id", "print", "n", "a", "h", "g")}
        doc = pa.array(np.repeat(np.arange(len(out["id"])), out["n"].to_numpy()))
        return out | {"id": out["id"].take(doc), "print": out["print"].take(doc)}

    def meet(group: pa.Table) -> pa.Table:
        known = flat(group.filter(group.column("known")))
        new = flat(group.filter(pc.invert(group.column("known"))))
        h, g = new["h"].to_numpy(), new["g"].to_numpy()
        order = np.lexsort((g, h))
        opens = np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0)])[:len(order)]
        of = np.cumsum(opens) - 1
        often = np.bincount(of, minlength=1)[of] > 1
        order, of = pa.array(order[often]), of[often]
        rows = pa.table({"of": of, **{c: new[c].take(order) for c in ("id", "print", "a")}})
        rows = rows.take(pc.sort_indices(rows, [(c, "ascending") for c in ("of", "id", "print", "a")], null_placement="at_end"))
        of = rows.column("of").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], np.diff(of) != 0])[:len(of)])
        first = pa.array(np.repeat(first, np.diff(np.append(first, len(of)))), pa.int64())
        later = rows.filter(pc.invert(_alike(rows, rows.take(first), ("id", "print", "a"))))
        return pa.concat_tables([later.select(["id", "print", "a"]).cast(found), pa.table({c: known[c] for c in ("id", "print", "a")}).cast(found)])

    later = packed.groupBy("segment").applyInArrow(meet, schema)
    return later.groupBy("id", "print").agg(F.array_sort(F.collect_set("a")).alias("cuts"))


def _arrow_kind(d: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(d.schema["id"].dataType)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = 3, least_words: int = 15) -> DataFrame:
    """The documents without repeated pieces, with ``n_removed`` pieces added."""
    @F.arrow_udf("struct<text:string,n:long>")
    def rest(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        out, removed = texts.to_pylist(), np.zeros(len(texts), np.int64)
        chosen = np.flatnonzero(pc.and_(pc.is_valid(texts), pc.is_valid(cuts)).to_numpy(zero_copy_only=False))
        places = cuts.take(pa.array(chosen)).to_pylist()
        for a, b, data, ends in text_slices(texts.take(pa.array(chosen))):
            cut = cut_texts(data, ends, run, least_words)
            raw = data.tobytes()
            spans = np.searchsorted(cut.text, np.arange(b - a + 1))
            bounds = np.append(cut.first, len(cut.pieces) - 1)
            for k in range(b - a):
                own = slice(spans[k], spans[k + 1])
                start, stop = cut.a[own], cut.b[own]
                gone = np.isin(start, places[a + k])
                level = np.zeros(bounds[k + 1] - bounds[k] + 1, np.int64)
                np.add.at(level, start[gone], 1)
                np.add.at(level, stop[gone], -1)
                stays = np.cumsum(level)[:-1] == 0
                edges = cut.pieces[bounds[k]:bounds[k + 1] + 1].copy()
                edges[-1] = ends[k] - 1  # not the line end behind the text
                out[chosen[a + k]] = b"".join(raw[x:y] for x, y, s in zip(edges[:-1].tolist(), edges[1:].tolist(), stays.tolist(), strict=True) if s).decode("utf-8", "surrogatepass")
                removed[chosen[a + k]] = int((~stays).sum())
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(removed)], names=["text", "n"])

    cut = repeated_places(docs, key, text, run, least_words).select(
        F.col("id").alias("_cut_id"), F.col("print").alias("_cut_print"), F.col("cuts").alias("_cuts"))
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_key"), text_print(text).alias("_print"))
    inner = inner.join(cut, F.col("_key").eqNullSafe(F.col("_cut_id")) & (F.col("_print") == F.col("_cut_print")), "left")
    out = inner.select("_row.*", "_cuts").withColumn("_rest", rest(F.col(text).cast("string"), F.col("_cuts")))
    return out.select(*[F.col("_rest.text").alias(c) if c == text else F.col(c) for c in docs.columns], F.col("_rest.n").alias("n_removed"))

"""Global order, running sums and digests over groups that may hold a third of all rows.

Rows are sorted by range, so a large group spreads over many partitions.  ``part`` names the partition and ``ord``
the place in the whole order; both are written with the rows, so they stay the same for every later job.  Windows
run per (group, part), and a part inherits what the parts before or behind it hold from one edge row per part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torqueline.llm.base import with_text_batches
from torqueline.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


def in_order(df: DataFrame, order: Sequence[str], deal: Sequence[str | Column] | None = None, name: str = "ordered") -> DataFrame:
    """The rows sorted by ``order`` (nulls first), written, with ``part`` and ``ord``.

    ``deal`` are the columns that partitions are cut by: a prefix of the order, or a coarser form of it, so that
    long texts need not travel to the driver as cut points.
    """
    dealt = df.repartitionByRange(*(deal or order)).sortWithinPartitions(*order)
    dealt = dealt.withColumn("ord", F.monotonically_increasing_id())  # grows with the partition, then with the row
    return settle(dealt.withColumn("part", F.shiftrightunsigned("ord", 33).cast("int")), name)


def same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def joined(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "left") -> DataFrame:
    """Join on columns whose nulls are equal; the columns stay once."""
    named = right.withColumnsRenamed({c: f"__r{i}" for i, c in enumerate(cols)})
    on = reduce(lambda a, b: a & b, [left[c].eqNullSafe(named[f"__r{i}"]) for i, c in enumerate(cols)])
    return left.join(named, on, how).drop(*[f"__r{i}" for i in range(len(cols))])


def running(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], order: str = "ord") -> DataFrame:
    """Add sums up to and including the row within its group; ``part`` must not fall along ``order``."""
    cells = [*keys, "part"]
    here = Window.partitionBy(*cells).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*cells).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    inherited = totals.select(*cells, *[F.sum(n).over(before).alias(f"__{n}") for n in sums])
    inherited = inherited.where(F.col(f"__{next(iter(sums))}").isNotNull())  # groups within one part inherit nothing
    out = joined(df.withColumns({n: F.sum(c).over(here) for n, c in sums.items()}), inherited, cells)
    return out.withColumns({n: F.col(n) + F.coalesce(F.col(f"__{n}"), F.lit(0)) for n in sums}).drop(*[f"__{n}" for n in sums])


def following(df: DataFrame, keys: Sequence[str], value: str, out: str, order: str = "ord") -> DataFrame:
    """Add the value of the next row of the group; null behind its last row."""
    cells = [*keys, "part"]
    first = df.groupBy(*cells).agg(F.min_by(value, order).alias(f"__{out}"))
    first = first.select(*cells, F.lead(f"__{out}").over(Window.partitionBy(*keys).orderBy("part")).alias(f"__{out}"))
    ahead = F.lead(value).over(Window.partitionBy(*cells).orderBy(order))
    both = joined(df.withColumn(out, ahead), first.where(F.col(f"__{out}").isNotNull()), cells)
    return both.withColumn(out, F.coalesce(out, f"__{out}")).drop(f"__{out}")


def joined_sha256(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: str, by: str, out: str = "sha256") -> DataFrame:
    """Keys and the SHA-256, in lower-case hex, of the group's pieces in order with ``by`` between them.

    A digest is sequential, so a group's pieces pass through one task; they are streamed in sorted order there and
    never held together.
    """
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(out, T.StringType())])
    arrow_keys, between = list(keys), by.encode()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        now, state, types = None, None, None
        for batch in batches:
            types = [batch.schema.field(k).type for k in arrow_keys]
            rows, digests = [], []
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in arrow_keys]
            for *key, text in zip(*columns, batch.column(batch.schema.get_field_index(piece)).to_pylist(), strict=True):
                if state is None or key != now:
                    if state is not None:
                        rows.append(now)
                        digests.append(state.hexdigest())
                    now, state = key, sha256()
                else:
                    state.update(between)
                state.update((text or "").encode("utf-8", "surrogatepass"))
            if rows:
                yield table(rows, digests, types)
        if state is not None:
            yield table([now], [state.hexdigest()], types)

    def table(rows, digests, types):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names=[*arrow_keys, out])

    dealt = df.select(*dict.fromkeys([*keys, *order, piece])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return with_text_batches(dealt).mapInArrow(stream, schema)

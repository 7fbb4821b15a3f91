"""Ordered scans over telemetry series that stay parallel when one series is huge.

A window partitioned by vehicle puts the whole vehicle in one task, and a window
with no key puts the whole table there.  A ``Timeline`` therefore cuts long series
into slabs of consecutive rows.  One narrow job takes a repeatable hash sample of
the ordering columns; every sampled series too long for one task gets cut points
from it.  Windows then run per (series, slab), each slab leaves one edge row, an
ordinary window over those few edge rows works out what each slab inherits, and a
broadcast join hands it back.  The inherited values are fetched as soon as a scan is
added: their number is bounded by ``MAX_CUTS``, and chained scans then cost one
narrow job each instead of nesting their plans.  Short series take the plain window,
with no job and no join.

Cut points are ordering values (time plus tie-break), so rows sharing a timestamp
are split as well, and the same row always falls into the same slab.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torqueline.session import settle

SLAB = "__slab"
ROWS_PER_SLAB = 2_000_000
SAMPLES_PER_SLAB = 32
# bound on the broadcast side: cut points (and so edge rows) never exceed this,
# longer tables get longer slabs
MAX_CUTS = 50_000


@dataclass(frozen=True)
class Timeline:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool = False

    def with_frame(self, df: DataFrame) -> "Timeline":
        return replace(self, df=df)

    def with_columns(self, columns: Mapping[str, Column]) -> "Timeline":
        return self.with_frame(self.df.withColumns(dict(columns)))

    def drop(self, *columns: str) -> "Timeline":
        return self.with_frame(self.df.drop(*columns))

    @property
    def frame(self) -> DataFrame:
        return self.df.drop(SLAB)

    def _window(self):
        cells = [*self.keys, SLAB] if self.split else list(self.keys)
        return Window.partitionBy(*cells).orderBy(*self.order)

    def scan(
        self,
        previous: Mapping[str, Column] = {},
        following: Mapping[str, Column] = {},
        latest: Mapping[str, Column] = {},
        upcoming: Mapping[str, Column] = {},
        running: Mapping[str, Column] = {},
        latest_before: Mapping[str, Column] = {},
    ) -> "Timeline":
        """Add columns that look along the series.

        previous / following: value of the row before / after;
        latest / upcoming: nearest present value at or before / at or after the row;
        latest_before: nearest present value before the row;
        running: sum up to and including the row.

        On cut series every scan costs a job, so put into one what does not build on
        each other.
        """
        scan = self._scan_split if self.split else self._scan_whole
        return scan(previous, following, latest, upcoming, running, latest_before)

    def _scan_whole(self, previous, following, latest, upcoming, running, latest_before) -> "Timeline":
        w = self._window()
        before = w.rowsBetween(Window.unboundedPreceding, 0)
        after = w.rowsBetween(0, Window.unboundedFollowing)
        out = {n: F.lag(c).over(w) for n, c in previous.items()}
        out |= {n: F.lead(c).over(w) for n, c in following.items()}
        out |= {n: F.last(c, ignorenulls=True).over(before) for n, c in latest.items()}
        out |= {n: F.first(c, ignorenulls=True).over(after) for n, c in upcoming.items()}
        out |= {n: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
                for n, c in latest_before.items()}
        out |= {n: F.sum(c).over(before) for n, c in running.items()}
        return self.with_columns(out)

    def _scan_split(self, previous, following, latest, upcoming, running, latest_before) -> "Timeline":
        place = F.struct(*self.order)

        def at_present(c: Column) -> Column:
            return F.when(c.isNotNull(), place)

        edges = (
            [F.max_by(F.struct(c.alias("v")), place).alias(n) for n, c in previous.items()]
            + [F.min_by(F.struct(c.alias("v")), place).alias(n) for n, c in following.items()]
            + [F.max_by(c, at_present(c)).alias(n) for n, c in {**latest, **latest_before}.items()]
            + [F.min_by(c, at_present(c)).alias(n) for n, c in upcoming.items()]
            + [F.sum(c).alias(n) for n, c in running.items()]
        )
        # slab 0 without a slab 1 is a short series: it neither leaves nor inherits anything,
        # so only rows of cut series reach this aggregate
        edge_rows = self.df.filter(F.col(SLAB) >= 0).groupBy(*self.keys, SLAB).agg(*edges)
        w = Window.partitionBy(*self.keys).orderBy(SLAB)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        later = w.rowsBetween(1, Window.unboundedFollowing)
        inherited = (
            [F.lag(n).over(w).alias(f"__{n}") for n in previous]
            + [F.lead(n).over(w).alias(f"__{n}") for n in following]
            + [F.last(n, ignorenulls=True).over(earlier).alias(f"__{n}") for n in [*latest, *latest_before]]
            + [F.first(n, ignorenulls=True).over(later).alias(f"__{n}") for n in upcoming]
            + [F.sum(n).over(earlier).alias(f"__{n}") for n in running]
        )
        cells = [*self.keys, SLAB]
        carry = edge_rows.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(cells)], *inherited)
        carry = self.df.sparkSession.createDataFrame(carry.collect(), carry.schema)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate(cells)])
        joined = self.df.join(F.broadcast(carry), same, "left")

        w = self._window()
        before = w.rowsBetween(Window.unboundedPreceding, 0)
        after = w.rowsBetween(0, Window.unboundedFollowing)

        def held(c: Column) -> Column:
            return F.struct(c.alias("v"))

        out = {n: F.coalesce(F.lag(held(c)).over(w), F.col(f"__{n}"))["v"] for n, c in previous.items()}
        out |= {n: F.coalesce(F.lead(held(c)).over(w), F.col(f"__{n}"))["v"] for n, c in following.items()}
        out |= {n: F.coalesce(F.last(c, ignorenulls=True).over(before), F.col(f"__{n}")) for n, c in latest.items()}
        out |= {n: F.coalesce(F.first(c, ignorenulls=True).over(after), F.col(f"__{n}")) for n, c in upcoming.items()}
        past = w.rowsBetween(Window.unboundedPreceding, -1)
        out |= {n: F.coalesce(F.last(c, ignorenulls=True).over(past), F.col(f"__{n}")) for n, c in latest_before.items()}
        for n, c in running.items():
            here = F.sum(c).over(before)
            out[n] = F.coalesce(here + F.col(f"__{n}"), here, F.col(f"__{n}"))
        helpers = [f"__{n}" for m in (previous, following, latest, upcoming, running, latest_before) for n in m]
        return self.with_frame(joined.withColumns(out).drop(*helpers, *[f"__c{i}" for i in range(len(cells))]))


def timeline(
    df: DataFrame,
    ts: str = "timestamp",
    partition_by: Sequence[str] = (),
    tie: Sequence[str] = (),
    rows_per_slab: int = ROWS_PER_SLAB,
) -> Timeline:
    """Order ``df`` by ``ts`` and ``tie`` within each series, cutting long series.

    ``tie`` must make the order unique within a series; without it the order of
    rows that share a timestamp is undefined, as it is in any engine.
    """
    order = (ts, *tie)
    plain = Timeline(df, tuple(partition_by), order)
    cuts = _cut_points(df, plain.keys, order, rows_per_slab)
    if not cuts:
        return plain
    # written once: every scan reads it for its edges and again for its rows
    return replace(plain, df=settle(_assign_slabs(df, plain.keys, order, cuts), "slabs"), split=True)


def _cut_points(df: DataFrame, keys: tuple, order: tuple, rows_per_slab: int) -> list:
    """(key values, cut points) of every series longer than one slab."""
    step = max(1, rows_per_slab // SAMPLES_PER_SLAB)
    per_slab = max(1, rows_per_slab // step)
    columns = list(dict.fromkeys([*keys, *order]))
    sample = df.select(*columns).filter(F.pmod(F.xxhash64(*columns), F.lit(step)) == 0).persist()
    try:
        groups = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        long_ones = groups.filter(F.col("__n") >= 2 * per_slab)
        total = long_ones.agg(F.sum("__n")).first()[0]
        if not total:
            return []
        stride = max(per_slab, -(-total // MAX_CUTS))
        w = Window.partitionBy(*keys).orderBy(*order)
        size = Window.partitionBy(*keys)
        marks = (
            sample.withColumn("__n", F.count(F.lit(1)).over(size))
            .filter(F.col("__n") >= 2 * per_slab)
            .withColumn("__r", F.row_number().over(w))
            .filter((F.col("__r") % stride == 0) & (F.col("__r") + stride <= F.col("__n") + 1))
        )
        place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
        found = marks.groupBy(*keys).agg(F.sort_array(F.collect_set(place)).alias("__cuts"))
        return _Cuts(found.collect(), found.schema)
    finally:
        sample.unpersist()


class _Cuts(list):
    def __init__(self, rows, schema: T.StructType):
        super().__init__(rows)
        self.schema = schema


def _assign_slabs(df: DataFrame, keys: tuple, order: tuple, cuts: _Cuts) -> DataFrame:
    """Add the slab number: how many cut points of the series are at or before the row.

    -1 marks rows of short series.  Two levels keep what a row carries small: the first counts among every
    ``span``-th cut point, the second among the cut points between two of those.  Both tables hold at most
    ``MAX_CUTS`` points and are broadcast.
    """
    spark = df.sparkSession
    span = math.isqrt(max(len(row["__cuts"]) for row in cuts) - 1) + 1
    kinds = [f for f in cuts.schema.fields if f.name != "__cuts"]
    points = cuts.schema["__cuts"].dataType
    coarse, fine = [], []
    for row in cuts:
        key, all_ = [row[f.name] for f in kinds], row["__cuts"]
        coarse.append((*key, all_[span - 1::span]))
        fine += [(*key, g, all_[a:a + span]) for g, a in enumerate(range(0, len(all_), span))]
    named = [T.StructField(f"__k{i}", f.dataType) for i, f in enumerate(kinds)]
    top = spark.createDataFrame(coarse, T.StructType([*named, T.StructField("__top", points)]))
    low = spark.createDataFrame(fine, T.StructType([*named, T.StructField("__g", T.IntegerType()), T.StructField("__low", points)]))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    drop = [f"__k{i}" for i in range(len(keys))]

    if keys:
        joined = df.join(F.broadcast(top), reduce(lambda a, b: a & b, same), "left").drop(*drop)
    else:
        joined = df.withColumn("__top", top.scalar())
    joined = joined.withColumn("__passed", _passed("__top", span + 1, order)).drop("__top")
    meets = reduce(lambda a, b: a & b, [*same, F.col("__passed") == F.col("__g")])
    joined = joined.join(F.broadcast(low), meets, "left").drop(*drop, "__g")
    slab = F.when(F.col("__passed").isNull(), F.lit(-1)).otherwise(
        F.col("__passed") * span + F.coalesce(_passed("__low", span, order), F.lit(0)))
    return joined.withColumn(SLAB, slab).drop("__low", "__passed")


def _passed(cuts: str, most: int, order: tuple) -> Column:
    """How many of at most ``most`` sorted cut points are at or before the row; null without cut points.

    A binary search, written as a fold over descending powers of two.
    """
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    steps = [F.lit(1 << i) for i in reversed(range(max(most, 1).bit_length()))]
    found = F.aggregate(F.array(*steps), F.lit(0), lambda done, step: F.when(
        F.get(F.col(cuts), done + step - 1) <= place, done + step).otherwise(done))
    return F.when(F.col(cuts).isNotNull(), found)

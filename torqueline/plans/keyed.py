"""Session cleaning of many sessions at once: K1 for every key of a table, in a fixed number of jobs.

Which columns a session keeps, its medians and its ranges are statistics per key.  A column that
:func:`~torqueline.plans.cleaning.clean_session` would drop from one session is null in that session's rows here, as
all sessions share one table; everything else is the same.  Statistics are grouped aggregates; medians come from
counted values ranked along slabs, so a session with a third of all rows is not one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torqueline.functions.numeric import outside_to_null, row_mean, safe_ratio, sentinel_to_null
from torqueline.operators.columns import numeric_columns
from torqueline.operators.timeline import timeline
from torqueline.plans.cleaning import RPM_RANGE
from torqueline.session import settle

# Derived columns and their inputs.
DERIVED = {
    "AVG_ENGINE_LOAD": ("ENGINE_LOAD", "ABSOLUTE_LOAD"), "TEMP_MEAN": ("INTAKE_TEMP", "OIL_TEMP", "COOLANT_TEMP"),
    "AIRFLOW_PER_RPM": ("MAF", "RPM"),
}


def _with(df: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    named = per_key.withColumnRenamed(key, "__key")
    return df.join(named, df[f"`{key}`"].eqNullSafe(named["__key"])).drop("__key")


def _count(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags], F.lit(0))


def kept_columns(df: DataFrame, key: str, protect: Sequence[str]) -> DataFrame:
    """(key, __live): per column of ``df`` but the key, whether it is neither constant nor equal to an earlier one."""
    cols = [f for f in df.schema.fields if f.name != key]
    row = F.xxhash64(*[F.col(f"`{f.name}`") for f in cols])
    aggregates = []
    for i, f in enumerate(cols):
        c = F.col(f"`{f.name}`")
        # a hash with the row's own, so that equal sums mean equal values row by row
        h = F.xxhash64(c, row)
        aggregates += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"),
                       F.struct(F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).alias(f"p{i}")]
    stats = df.groupBy(key).agg(*aggregates)
    fixed = {i: F.lit(False) if f.name in protect else (F.col(f"n{i}") == 0) | (F.col(f"a{i}") == F.col(f"b{i}")) for i, f in enumerate(cols)}
    stats = stats.withColumns({f"f{i}": F.coalesce(v, F.lit(False)) for i, v in fixed.items()})
    live = []
    for i, f in enumerate(cols):
        same = [(F.col(f"p{i}") == F.col(f"p{j}")) & ~F.col(f"f{j}") for j in range(i) if cols[j].dataType == f.dataType]
        live.append(~(reduce(lambda a, b: a | b, same, F.col(f"f{i}"))))
    return stats.select(key, F.array(*live).alias("__live"))


def medians_by_key(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """(key, __median): map from the number of a column to its exact median."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(cols)]))
    counts = df.select(F.col(f"`{key}`").alias("k"), values.alias("s")).select("k", "s.i", "s.v").where("v IS NOT NULL AND NOT isnan(v)")
    counts = settle(counts.groupBy("k", "i", "v").agg(F.count("*").alias("n")), "counts")
    ranked = timeline(counts, "v", ["k", "i"]).scan(running={"upto": F.col("n")}).frame
    total = counts.groupBy(F.col("k").alias("tk"), F.col("i").alias("ti")).agg((F.sum("n") - 1).alias("last"))
    both = ranked.join(total, F.col("k").eqNullSafe(F.col("tk")) & (F.col("i") == F.col("ti")))
    low, high = F.floor(F.col("last") / 2), F.ceil(F.col("last") / 2)
    found = both.groupBy("k", "i").agg(F.min(F.when(F.col("upto") > low, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > high, F.col("v"))).alias("b"))
    middle = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * 0.5)
    return found.groupBy(F.col("k").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("i", middle))).alias("__median"))


def clean_sessions(df: DataFrame, key: str, ts: str = "timestamp", protect: Sequence[str] = ("timestamp", "driving_style"),
                   protect_all: bool = False) -> DataFrame:
    """Every session of ``df`` pruned, median-filled and scaled to [0, 1] on its own, with derived columns.

    A column is there if it has values in any session.  An empty table gives an empty result.
    """
    cols = [f.name for f in df.schema.fields if f.name != key and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    df, numeric = df.select(key, *cols), [c for c in numeric_columns(df) if c != key]
    place = {c: i for i, c in enumerate(cols)}

    def live(c: str) -> Column:
        return F.col("__live")[place[c]]

    def is_null(c: str) -> Column:
        return F.col(f"`{c}`").isNull()

    masked = _with(df, kept_columns(df, key, protect), key)
    masked = masked.withColumns({c: F.when(live(c), F.col(f"`{c}`")) for c in cols}).dropDuplicates([key, *cols])
    masked = masked.withColumns({c: sentinel_to_null(c) for c in numeric})
    others = [c for c in cols if c != ts]
    # as many columns as the session has left, less the time
    allowed = F.floor(0.8 * (_count([live(c) for c in cols]) - (1 if ts in cols else 0) + (0 if ts in cols else -1)))
    rows = settle(masked.where(_count([live(c) & is_null(c) for c in others]) <= allowed), "sessions")

    safe = set(protect) if protect_all else set()
    sparse = rows.groupBy(key).agg(F.array(*[
        F.lit(c not in safe) & (F.count_if(is_null(c)) / F.count(F.lit(1)) > 0.8) for c in cols]).alias("__sparse"))
    rows = _with(rows, sparse, key).withColumn("__live", F.zip_with("__live", "__sparse", lambda a, b: a & ~b)).drop("__sparse")
    rows = rows.withColumns({c: F.when(live(c), F.col(f"`{c}`")) for c in cols})
    rows = rows.where(_count([live(c) & ~is_null(c) for c in others]) >= 2)
    if "RPM" in numeric:
        rows = rows.withColumn("RPM", outside_to_null("RPM", *RPM_RANGE))
    rows = settle(rows, "pruned")

    if numeric:
        ends = rows.groupBy(key).agg(*[F.struct(F.min(F.col(f"`{c}`").cast("double")).alias("lo"), F.max(F.col(f"`{c}`").cast("double")).alias("hi")).alias(f"__e{i}") for i, c in enumerate(numeric)])
        middle = medians_by_key(rows, key, numeric).withColumnRenamed(key, "__mk")
        rows = _with(rows, ends.join(middle, ends[f"`{key}`"].eqNullSafe(middle["__mk"]), "left").drop("__mk"), key)
        out = {}
        for i, c in enumerate(numeric):
            lo, hi = F.col(f"__e{i}.lo"), F.col(f"__e{i}.hi")
            filled = F.coalesce(F.col(f"`{c}`").cast("double"), F.col("__median")[F.lit(i)])
            out[c] = F.when(lo == hi, F.when(filled.isNotNull(), F.lit(0.0))).otherwise((filled - lo) / (hi - lo))
        rows = rows.withColumns(out)
    derived = {}
    for name, inputs in DERIVED.items():
        if set(inputs) <= set(cols):
            value = safe_ratio(*inputs) if name == "AIRFLOW_PER_RPM" else row_mean(*inputs)
            derived[name] = F.when(reduce(lambda a, b: a & b, [live(c) for c in inputs]), value)
    return rows.withColumns(derived).select(key, *cols, *derived)

"""Categories and maps to columns: F22, F23, F26."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torqueline.functions.numeric import to_number
from torqueline.operators.timeline import timeline
from torqueline.session import settle


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value): distinct present values of several columns, one job."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ]))
    return df.select(cells.alias("x")).select("x.*").filter(F.col("value").isNotNull()).distinct()


def category_codes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, code) with the rank of each value from 0."""
    ranked = timeline(distinct_values(df, cols), "value", ["column"]).scan(running={"code": F.lit(1)})
    return ranked.frame.withColumn("code", (F.col("code") - 1).cast("int"))


def label_encode(df: DataFrame, cols: Sequence[str], missing: int = -1, suffix: str = "") -> DataFrame:
    """Replace text columns by the rank of their value in sorted order; missing gets ``missing``."""
    if not cols:
        return df
    codes = settle(category_codes(df, cols).select("column", "value", "code"), "codes")
    order = df.columns + ([f"{c}{suffix}" for c in cols] if suffix else [])
    for c in cols:
        one = codes.filter(F.col("column") == c).select(
            F.col("value").alias("__value"), F.col("code").alias("__code")
        )
        joined = df.join(one, F.col(c).cast("string") == F.col("__value"), "left")
        df = joined.withColumn(f"{c}{suffix}", F.coalesce("__code", F.lit(missing))).drop("__value", "__code")
    return df.select(*order)


def _new_columns(values: DataFrame, what: str, most: int | None) -> list:
    rows = (values if most is None else values.limit(most + 1)).collect()
    if most is not None and len(rows) > most:
        raise ValueError(f"more than {most} distinct {what}")
    return rows


def one_hot_drop_first(df: DataFrame, cols: Sequence[str], most: int | None = None) -> DataFrame:
    """0/1 column per category except the smallest; a missing value is 0 in all of them.

    Every category becomes a column, so a caller who expects few may refuse more than ``most``.
    """
    found = _new_columns(distinct_values(df, cols), f"values of {', '.join(cols)}", most)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    new = {}
    for c in cols:
        values = sorted((r["value"] for r in found if r["column"] == c), key=float if c in numeric else None)
        text = F.col(c).cast("string")
        new |= {f"{c}_{v}": F.coalesce((text == F.lit(v)).cast("int"), F.lit(0)) for v in values[1:]}
    return df.withColumns(new).drop(*cols)


def map_to_columns(df: DataFrame, col: str = "data", keys: Sequence[str] | None = None, numeric: bool = True,
                   most: int | None = None) -> DataFrame:
    """One column per map key; rows without the key get NULL.  Numbers unless told otherwise.

    Without ``keys`` the keys are looked up first; ``most`` refuses more of them.
    """
    if keys is None:
        names = df.select(F.explode(F.map_keys(col)).alias("k")).distinct()
        keys = sorted(r["k"] for r in _new_columns(names, f"keys of {col}", most))
    new = {}
    for k in keys:
        raw = F.try_element_at(F.col(col), F.lit(k))
        new[k] = to_number(raw) if numeric else raw
    return df.withColumns(new).drop(col)


def json_object(c: Column | str) -> Column:
    """JSON object text to a string map, the shape of a message body."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, T.MapType(T.StringType(), T.StringType()))

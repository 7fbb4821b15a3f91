"""Column pruning and selection: P1-P7 and the data-dependent P17-P21."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torqueline.functions import sql


def select_existing(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select([c for c in keep if c in df.columns])


def drop_existing(df: DataFrame, unwanted: Iterable[str]) -> DataFrame:
    return df.drop(*unwanted)


def rename_map(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def normalised_name(name: str) -> str:
    """Trim, drop a stray ``Â``, spell the degree sign ``°C``, drop brackets, undo a double C."""
    name = name.strip().replace("Â", "").replace("°", "°C")
    return name.replace("[", "").replace("]", "").replace("°CC", "°C")


def normalise_column_names(df: DataFrame) -> DataFrame:
    names = [normalised_name(c) for c in df.columns]
    clash = sorted({n for n in names if names.count(n) > 1})
    if clash:
        raise ValueError(f"column names clash after cleaning: {clash}")
    return df.toDF(*names)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def ensure_columns(df: DataFrame, needed: Iterable[str], kind: str = "double") -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c in needed if c not in df.columns})


def tag_column(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def schema_intersection(dfs: Sequence[DataFrame]) -> list[str]:
    """Columns all frames share, in the first one's order."""
    return [c for c in dfs[0].columns if all(c in d.columns for d in dfs[1:])]


def has_columns(df: DataFrame, names: Iterable[str]) -> bool:
    return set(names) <= set(df.columns)


def _comparable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def column_extremes(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    """(present rows, min, max) per column, one job."""
    if not cols:
        return {}
    row = df.selectExpr(*[f"{_extremes(c)} AS s{i}" for i, c in enumerate(cols)]).first()
    return {c: tuple(row[i]) for i, c in enumerate(cols)}


def _extremes(c: str) -> str:
    x = sql.name(c)
    return f"struct(count({x}), min({x}), max({x}))"


def constant_columns(df: DataFrame, protect: Iterable[str] = ()) -> list[str]:
    """Columns with at most one distinct present value (min equals max, or none at all)."""
    cols = [c for c in _comparable(df) if c not in set(protect)]
    return [c for c, (n, lo, hi) in column_extremes(df, cols).items() if n == 0 or lo == hi]


def drop_constant_columns(df: DataFrame, protect: Iterable[str] = ()) -> DataFrame:
    return df.drop(*constant_columns(df, protect))


def _fingerprint(c: str) -> str:
    """Order-free summary of a column: equal columns have equal ones."""
    h = f"xxhash64({sql.name(c)})"
    return f"struct(count({sql.name(c)}), bit_xor({h}), sum(CAST({h} AS DECIMAL(20, 0))))"


def _repeated(df: DataFrame, cols: Sequence[str], prints: dict[str, tuple]) -> list[str]:
    """Columns equal to an earlier one; only those with equal fingerprints are compared."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    groups: dict[tuple, list[str]] = {}
    for c in cols:
        groups.setdefault((kinds[c], *prints[c]), []).append(c)
    pairs = [(a, b) for g in groups.values() for j, b in enumerate(g) for a in g[:j]]
    if not pairs:
        return []
    same = df.selectExpr(*[
        f"bool_and({sql.name(a)} <=> {sql.name(b)}) AS e{i}" for i, (a, b) in enumerate(pairs)
    ]).first()
    return list(dict.fromkeys(b for i, (_, b) in enumerate(pairs) if same[i] is not False))


def identical_columns(df: DataFrame) -> list[str]:
    """Columns equal, row by row, to an earlier one of the same type (NULL equals NULL)."""
    cols = _comparable(df)
    if not cols:
        return []
    row = df.selectExpr(*[f"{_fingerprint(c)} AS s{i}" for i, c in enumerate(cols)]).first()
    return _repeated(df, cols, {c: tuple(row[i]) for i, c in enumerate(cols)})


def drop_constant_and_identical(df: DataFrame, protect: Iterable[str] = ()) -> DataFrame:
    """:func:`drop_constant_columns`, then :func:`drop_identical_columns`, from one statistics job."""
    cols = _comparable(df)
    if not cols:
        return df
    row = df.selectExpr(
        *[f"{_extremes(c)} AS m{i}" for i, c in enumerate(cols)],
        *[f"{_fingerprint(c)} AS s{i}" for i, c in enumerate(cols)],
    ).first()
    ends = {c: tuple(row[f"m{i}"]) for i, c in enumerate(cols)}
    prints = {c: tuple(row[f"s{i}"]) for i, c in enumerate(cols)}
    fixed = [c for c in cols if c not in set(protect) and (not ends[c][0] or ends[c][1] == ends[c][2])]
    return df.drop(*fixed, *_repeated(df, [c for c in cols if c not in fixed], prints))


def drop_identical_columns(df: DataFrame) -> DataFrame:
    return df.drop(*identical_columns(df))


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Rows, and missing values per column, one job."""
    row = df.selectExpr(
        "count(1)", *[f"count_if({sql.name(c)} IS NULL) AS c{i}" for i, c in enumerate(df.columns)]
    ).first()
    return row[0], {c: row[i + 1] for i, c in enumerate(df.columns)}


def drop_sparse_columns(df: DataFrame, ratio: float = 0.8, protect: Iterable[str] = ()) -> DataFrame:
    rows, nulls = null_counts(df)
    return df.drop(*[c for c, n in nulls.items() if c not in set(protect) and rows and n / rows > ratio])


def drop_columns_null_count(df: DataFrame, most: int = 5000) -> DataFrame:
    _, nulls = null_counts(df)
    return df.drop(*[c for c, n in nulls.items() if n > most])


def all_null_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    rows, nulls = null_counts(df.select(*cols))
    return [c for c, n in nulls.items() if n == rows]


def drop_all_null_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*all_null_columns(df, cols))

"""CSV logs with differing headers: S1-S8.

One ``read.csv`` over files whose headers differ lines columns up by position, without
an error.  Files are therefore grouped by their column names first, each group is read
with its own declared schema, and the groups are united by name.

The dialect is the usual one: a quote inside a quoted field is doubled, quoted fields may hold line ends, and a fixed
list of spellings stands for a missing value.  Files where a line leaves a quote open are read whole, by one task
each; all others can be split.
"""

from __future__ import annotations

import csv
import fnmatch
import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from torqueline.functions.numeric import to_number
from torqueline.functions.text import parse_timestamp
from torqueline.operators.joins import union_logs
from torqueline.schema import FILE_PREFIXES, TEXT_COLUMNS

# order of rows in the files: part of the tie-break of every sequence operator
PROVENANCE = ("source_file", "source_block", "row_no")

# Spellings of a missing value in the logs.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package


@dataclass(frozen=True)
class HeaderGroup:
    columns: tuple[str, ...]
    paths: tuple[str, ...]


def file_inventory(spark: SparkSession, path: str, expected: Iterable[str] | None = None, pattern: str = "*") -> DataFrame:
    """File names and sizes in MB; with ``expected``, also the listed files that are missing."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("length") / 1e6).alias("size_mb"))
    )
    if expected is None:
        return files.withColumn("present", F.lit(True))
    wanted = spark.createDataFrame([(f,) for f in expected], "file string")
    return wanted.join(files, "file", "left").withColumn("present", F.col("size_mb").isNotNull())


def _split_header(line: str) -> tuple[str, ...]:
    """Column names of a header; a repeated name gets the next free number."""
    names: list[str] = []
    seen: dict[str, int] = {}
    for name in next(csv.reader([line.lstrip("\ufeff")]), []):
        new, n = name, seen.get(name, 0)
        while new in seen:
            n += bool(n) or 1
            new = f"{name}.{n}"
        seen[name], seen[new] = n, seen.get(new, 0)
        names.append(new)
    return tuple(names)


def _first_line(uri: str) -> str:
    from pyarrow import fs

    uri = re.sub("^file:/+", "file:///", re.sub("^s3a:", "s3:", uri))
    source, path = fs.FileSystem.from_uri(uri)
    with source.open_input_stream(path) as stream:
        head = b""
        while b"\n" not in head and (block := stream.read(8192)):
            head += block
    return head.split(b"\n")[0].decode("utf-8").rstrip("\r")


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        yield pd.DataFrame({"path": files["path"], "header": [_first_line(p) for p in files["path"]]})


def header_signature(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """First line of each file: tasks open their files and read up to the first line end.

    Where Arrow cannot open the first file, :func:`header_scan` does it with the text
    source, at the price of reading the files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).filter("length > 0").select("path")
    one = files.first()
    try:
        if one:
            _first_line(one["path"])
    except (OSError, ValueError, NotImplementedError):
        return header_scan(spark, path, pattern)
    return files.mapInPandas(_first_lines, "path string, header string")


def header_scan(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.csv") -> DataFrame:
    """First line of each file from a scan of their text."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    return lines.filter(F.col("start") == 0).groupBy("path").agg(F.min_by("value", "at").alias("header"))


def header_groups(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.csv",
                  exclude: Iterable[str] = ()) -> list[HeaderGroup]:
    """Files by exact ordered header; ``exclude`` holds name patterns of a job's own output."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in header_signature(spark, path, pattern).orderBy("path").collect():
        name = row["path"].rsplit("/", 1)[-1]
        if not any(fnmatch.fnmatch(name, e) for e in exclude):
            groups.setdefault(_split_header(row["header"]), []).append(row["path"])
    return [HeaderGroup(names, tuple(p)) for names, p in groups.items()]


def _open_quotes(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """Files in which a line has an odd number of quotes, so that a field goes on in the next."""
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"))
    odd = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return {r["path"] for r in lines.where(odd % 2 == 1).select("path").distinct().collect()}


def read_group(spark: SparkSession, group: HeaderGroup) -> DataFrame:
    """Raw text columns of one header group, with provenance; missing values are null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in group.columns])
    uneven = _open_quotes(spark, group.paths)
    whole = [p for p in group.paths if _plain(p) in {_plain(u) for u in uneven}]
    parts = []
    for paths, lines in (([p for p in group.paths if p not in whole], False), (whole, True)):
        if paths:
            reader = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            raw = reader.option("multiLine", lines).option("enforceSchema", True).csv(paths)
            parts.append(raw.select(
                *[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in group.columns],
                F.col("_metadata.file_name").alias("source_file"),
                F.col("_metadata.file_block_start").alias("source_block"),
                F.monotonically_increasing_id().alias("row_no"),
            ))
    return union_logs(parts)


def _plain(uri: str) -> str:
    return re.sub("^file:/+", "/", uri)


def typed(df: DataFrame, ts: str | None = "timestamp", text: Iterable[str] = TEXT_COLUMNS) -> DataFrame:
    """Declared types by name: the timestamp, known text columns, numbers for all others."""
    keep = set(text) | set(PROVENANCE)
    out: dict[str, Column] = {}
    for c in df.columns:
        if c == ts:
            out[c] = parse_timestamp(F.col(f"`{c}`"))
        elif c not in keep:
            out[c] = to_number(F.col(f"`{c}`"))
    return df.withColumns(out)


def read_logs(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.csv", exclude: Iterable[str] = (),
              how: str = "outer", ts: str | None = "timestamp", text: Iterable[str] = TEXT_COLUMNS,
              provenance: bool = True) -> DataFrame:
    """All logs below ``path`` as one typed frame, united over all or over the shared columns."""
    groups = header_groups(spark, path, pattern, exclude)
    if not groups:
        raise FileNotFoundError(f"no file matches {pattern} in {path}")
    out = union_logs([typed(read_group(spark, g), ts, text) for g in groups], how)
    return out if provenance else out.drop(*PROVENANCE)


def union_by_schema_group(spark: SparkSession, path: str, pattern: str = "*.csv", exclude: Iterable[str] = ("combined_*",),
                          ts: str | None = "timestamp", text: Iterable[str] = TEXT_COLUMNS) -> dict[str, DataFrame]:
    """``{combined_i: frame}`` for each header shared by at least two files, rows tagged by file."""
    groups = header_groups(spark, path, pattern, exclude)
    return {
        f"combined_{i}": typed(read_group(spark, g), ts, text).drop("source_block", "row_no")
        for i, g in enumerate(groups, 1) if len(g.paths) > 1
    }


def prefix_of(name: Column | str, prefixes: Sequence[str] = FILE_PREFIXES) -> Column:
    """First listed prefix a file name starts with, else NULL."""
    name = F.col(name) if isinstance(name, str) else name
    out = F.lit(None).cast("string")
    for p in reversed(prefixes):
        out = F.when(name.startswith(p), F.lit(p)).otherwise(out)
    return out


def union_by_prefix_group(spark: SparkSession, path: str, prefixes: Sequence[str] = FILE_PREFIXES, pattern: str = "*.csv",
                          exclude: Iterable[str] = ("*_merged.csv",), ts: str | None = "timestamp",
                          text: Iterable[str] = TEXT_COLUMNS) -> DataFrame:
    """All prefixed files as one frame with ``source_type``; write it partitioned by that column."""
    df = read_logs(spark, path, pattern, exclude, ts=ts, text=text)
    return df.withColumn("source_type", prefix_of("source_file", prefixes)).filter(
        F.col("source_type").isNotNull()).drop("source_block", "row_no")

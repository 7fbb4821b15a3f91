"""Word expressions and the registry shared by the operators of this subpackage."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torqueline.session import prepare

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

SPACES = r"[\x20\x09-\x0D]+"
TOKEN = r"[^\x20\x09-\x0D]+"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


# Whole texts go to Python in batches; ten thousand of them, the default, are too many for small executors.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def with_text_batches(df: DataFrame) -> DataFrame:
    """The same frame; its session sends texts to Python in batches of bounded rows and bytes."""
    for key, value in TEXT_BATCHES.items():
        df.sparkSession.conf.set(key, value)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case; null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), PUNCTUATION), "")

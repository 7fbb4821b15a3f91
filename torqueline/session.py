"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_open: ContextVar[list[str] | None] = ContextVar("scratch tables of the innermost block", default=None)

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # partial session windows are merged before the shuffle, so a hot series sends sessions, not rows
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}

# A write's shuffle files serve nothing once its table stands; else they stay until the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# cost of every Column call is mostly the call-site record kept for error messages
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "torqueline", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **START_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Put the runtime settings every operator relies on into an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets one temporary
    folder per session.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="torqueline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    if _open.get() is not None:
        _open.get().append(path)
    return path


def settle(df: DataFrame, name: str = "stage", path: str | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    Used where several statistics jobs follow an expensive shuffle: each of them
    then reads only its columns from Parquet, and a lost executor costs a re-read
    rather than the whole lineage.  The shuffle files of the write go with its end.
    A ``path`` that :func:`scratch_path` gave before a :func:`scratch` block outlives the block.  ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**options or {}).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows dealt by a hash of their values into ``parts`` partitions, sorted in each.

    MLlib draws per partition, so this makes a fitted model follow from the rows and ``parts`` alone.  ``parts``
    defaults to ``spark.sql.shuffle.partitions``, the session's setting for the size of its data.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = [f"`{f.name}`" for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    return df.repartition(n, *plain).sortWithinPartitions(*plain) if plain else df.repartition(n)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that :func:`settle` and :func:`scratch_path` place inside this block when it ends.

    Results that still read from them have to be written before.
    """
    mine: list[str] = []
    token = _open.set(mine)
    try:
        yield
    finally:
        _open.reset(token)
        for path in mine:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

"""What near-dedup leaves on disk while it runs."""

from __future__ import annotations

import os
import time

from llm.test_similar import crowd, kept_by_hand
from pyspark.sql import functions as F

from torqueline.llm import similar, simhash
from torqueline.session import settle, shared_dir


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_stands(spark):
    before = shuffle_files(spark)
    table = settle(spark.range(20_000).groupBy((F.col("id") % 9999).alias("k")).count())
    until = time.time() + 5
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert table.count() == 9999
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"


def test_tiles_of_sketches_do_not_stay(spark, monkeypatch):
    """No round of pivots, so tiles of sketches are made; those of the verified crowds are the only ones left."""
    monkeypatch.setattr(similar, "ROUNDS", 0)
    docs = crowd()
    before = set(os.listdir(shared_dir(spark)))
    got = similar.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    left = [name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark))) - before]
    assert left.count("tiles") == 1 and not {"prefixes", "tokens"} & set(left)
    assert sorted(r.doc_id for r in got.collect()) == kept_by_hand(docs)


def test_stars_end_without_a_further_round(spark, monkeypatch):
    names = []
    monkeypatch.setattr(simhash, "settle", lambda df, name: names.append(name) or settle(df, name))
    stars = [(10 * i + j, 10 * i) for i in range(5) for j in range(1, 9)]
    assert sorted(map(tuple, simhash.components(spark.createDataFrame(stars, "u long, v long")).collect())) == stars
    assert names == ["edges"]

from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet consectetur " * 4000

# ids repeat, are null, and texts are null, empty, blank, repeated and very long
EDGE = [
    (1, "One two three four five six seven eight nine ten eleven twelve. All rights reserved.", "en", "a"),
    (1, "One two three four five six seven eight nine ten eleven twelve. All rights reserved.", "en", "a"),
    (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n", "en", None), (None, "Card 4111111111111111 and token=abcdef123", "en", "b"),
    (None, None, None, None), (5, LONG, "en", "a"), (6, "Ünïcödé ΑΒΓ \U0001f600 Über a@b.example.org", "de", "c"), (7, "x", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = "n_words size score pos words spans items id print gram key taken target labels kind n rows start end band"


def sorted_rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with every odd case, and extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(EDGE, SCHEMA)
    return docs.withColumns({c: F.lit(7) for c in CLASHES.split()}).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

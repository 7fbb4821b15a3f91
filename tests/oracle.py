"""Side-by-side check of a query and its SQL twin.

Run as a script: ``python tests/oracle.py [sf_dir] [name part ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    mine = sorted(df.columns)
    if mine != sorted(names):
        return f"columns {mine} != {sorted(names)}"
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if KINDS.get(t, t) != kinds[c]}
    place = [names.index(c) for c in mine]
    theirs = sorted(tuple(_cell(r[i]) for i in place) for r in cur.fetchall())
    rows = df.select(*[f"`{c}`" for c in mine]).collect()
    ours = sorted(tuple(_cell(v) for v in r) for r in rows)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, e.g. {bad[0]}"
    return f"types {odd}" if odd else None


def main() -> None:
    from bindings import REGISTRY
    from torqueline import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name, (fn, sql) in REGISTRY.items():
        if len(sys.argv) > 2 and not any(p in name for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            said = compare(df, con, sql) if sql else None
            note = "" if sql else f" rows only: {len(df.collect())} {df.columns}"
        except Exception as e:  # noqa: BLE001 - a report over all queries
            said, note = f"{type(e).__name__}: {str(e)[:600]}", ""
        print(f"{'FAIL' if said else 'ok  '} {name} {time.time() - start:.1f}s{note} {said or ''}", flush=True)
        if said:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()

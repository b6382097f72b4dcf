"""Compare registered queries with their SQL: ``python tests/oracle.py SF_DIR [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}".replace("-0.000000", "0.000000")
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql) -> str | None:
    """None when both sides agree, else a description."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    got_rows = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    got, want = rows_of(spark_df.columns, got_rows), rows_of(names, want_rows)
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"{len(got)} rows != {len(want)}; only spark {extra[0]}; only sql {extra[1]}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference\n  spark {g}\n  sql   {w}"
    return None if got else "no rows"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracles:
                diff = difference(df, con, oracles[name])
            else:
                diff = None if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001
            diff = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += diff is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'ok  ' if diff is None else 'FAIL'} {kind} {name} {time.time() - start:.1f}s", flush=True)
        if diff:
            print("   ", diff[:1800], flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(main())

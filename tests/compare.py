"""Compare registered queries with their SQL: `python tests/compare.py SF_DIR [name ...]`."""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def table_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(made, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r))


def _close(a: tuple, b: tuple, slack: float) -> bool:
    return all(abs(x - y) <= slack if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b))


def differences(spark, con, name: str, sf_dir: str, query, sql: str, slack: float = 0) -> list[str]:
    df = query(spark, sf_dir)
    got_columns, got = table_of(df.columns, df.collect())
    answer = con.execute(sql)
    want_columns, want = table_of([d[0] for d in answer.description], answer.fetchall())
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    if len(got) != len(want):
        return [f"{len(got)} rows, expected {len(want)}"]
    return [f"{g} != {w}" for g, w in zip(got, want) if g != w and not (slack and _close(g, w, slack))]


def main() -> int:
    from pyspark.sql import SparkSession

    from checks import ORACLES, QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = oracle_connection(sf_dir), 0
    for name in names:
        began = time.time()
        try:
            wrong = differences(spark, con, name, sf_dir, QUERIES[name], ORACLES[name]) if name in ORACLES else ["no SQL"]
        except Exception as error:  # report and go on with the next query
            wrong = [f"{type(error).__name__}: {str(error)[:900]}"]
        bad += bool(wrong)
        print(f"{'BAD' if wrong else 'ok '} {name:28s} {time.time() - began:6.2f}s {len(wrong) or ''}", *wrong[:3], sep="\n     " if wrong else " ", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

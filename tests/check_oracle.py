"""Run every registered query against its SQL in DuckDB: ``python tests/check_oracle.py [sf_dir] [name …]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalog.views import _TABLES  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in _TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float):
        return value + 0.0
    return value


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when rows, names and kinds of values agree, else what differs."""
    df = fn(spark, sf_dir)
    found = _rows(df.collect(), df.columns)
    if sql is None:
        return None if found else "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    wanted = _rows(result.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(found) != len(wanted):
        return f"{len(found)} rows != {len(wanted)}"
    types = {d[0]: str(d[1]).lower() for d in result.description}
    kinds = {"varchar": "string", "integer": "int"}
    for column, kind in df.dtypes:
        if kinds.get(types[column], types[column]) != kind:
            print(f"      note: {name}.{column} is {kind} here, {types[column]} there")
    if found != wanted:
        i = next(i for i, (a, b) in enumerate(zip(found, wanted)) if a != b)
        return f"row {i}: {str(found[i])[:600]} != {str(wanted[i])[:600]}"
    return None if found else "no rows"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad = connect(sf_dir), e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, fn, oracle.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        kind = "sql " if name in oracle else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())

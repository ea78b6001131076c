"""Run a registered query beside its DuckDB oracle and compare rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

from ruleloom.catalog.inputs import TABLES


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(repr(tuple(_cell(r[k]) for k in order)) for r in rows)


def compare(spark, con, sf_dir, name, run, sql):
    """None when equal, else a short account of the difference."""
    df = run(spark, sf_dir)
    got_columns, got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} vs {want_columns}"
    types = dict(df.dtypes)
    odd = [(d[0], types[d[0]], str(d[1])) for d in result.description if SQL_TYPES.get(types[d[0]], "?") != str(d[1]).upper()]
    if odd:
        return f"types {odd}"
    if got != want:
        only_got, only_want = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return f"rows {len(got)} vs {len(want)}\n  spark:  {only_got[:2]}\n  oracle: {only_want[:2]}"
    return None if got else "no rows"


if __name__ == "__main__":
    from ruleloom.catalog import all_oracles, all_queries
    from ruleloom.session import build_session

    spark = build_session(cores="8")
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = os.environ.get("RULELOOM_SF_DIR", "/root/testdata/sf0.01")
    con = connect(sf_dir)
    oracles = all_oracles()
    wanted = sys.argv[1:]
    for name, run in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            verdict = compare(spark, con, sf_dir, name, run, oracles.get(name))
        except Exception as err:  # noqa: BLE001
            verdict = f"{type(err).__name__}: {str(err)[:900]}"
        kind = "=" if name in oracles else "~"
        print(f"{'ok  ' if verdict is None else 'FAIL'} {kind} {name} {time.time() - started:.1f}s {verdict or ''}", flush=True)

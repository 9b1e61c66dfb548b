"""Compare registered queries with their SQL on the same tables.

    python -m suite.check [sf_dir] [query ...]
"""

import math
import sys
import time

import duckdb
import pandas as pd

from suite.oracle import oracles
from suite.queries import QUERIES
from suite.session import local_session

SQL_TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
    "BOOLEAN": "boolean",
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(value) -> str:
    """A value as text: exact for doubles, the same for both engines' row types."""
    if value is None or value is pd.NaT:
        return "NULL"
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(value)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in data)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, float, int]:
    """(verdict, seconds, rows) for one query."""
    started = time.perf_counter()
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    seconds = time.perf_counter() - started
    statement = oracles().get(name)
    if statement is None:
        return "rows only", seconds, len(got)
    result = con.execute(statement)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} against {sorted(columns)}", seconds, len(got)
    kinds = dict(zip(columns, (SQL_TYPES.get(str(d[1]), str(d[1])) for d in result.description)))
    if kinds != dict(df.dtypes):
        apart = {c: (kind, kinds[c]) for c, kind in df.dtypes if kind != kinds[c]}
        return f"TYPES {apart}", seconds, len(got)
    mine, other = rows(df.columns, got), rows(columns, result.fetchall())
    if mine != other:
        extra, lack = set(mine) - set(other), set(other) - set(mine)
        detail = f"{len(mine)} rows against {len(other)}; {sorted(extra)[:2]} against {sorted(lack)[:2]}"
        return f"DIFFERENT {detail}", seconds, len(got)
    return "equal", seconds, len(got)


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("check")
    con = connect(sf_dir)
    bad = 0
    for name in argv[1:] or QUERIES:
        try:
            verdict, seconds, count = compare(spark, con, sf_dir, name)
        except Exception as error:  # report every query, whatever happens to one
            verdict, seconds, count = f"ERROR {str(error)[:600]}", 0.0, 0
        bad += verdict not in ("equal", "rows only")
        print(f"{name:30s} {seconds:7.2f}s {count:8d} rows  {verdict}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

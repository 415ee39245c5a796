"""Runs registered queries on Spark and their SQL on DuckDB and compares the results.

    python tests/oracle_check.py <sf_dir> [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


def compare(df, con, sql: str) -> str:
    """Empty when columns, types and rows agree, else the first difference."""
    relation = con.sql(sql)
    mine = {name: _KINDS.get(kind, kind) for name, kind in df.dtypes}
    theirs = dict(zip(relation.columns, (str(t) for t in relation.types), strict=True))
    if mine != theirs:
        wrong = {c: (mine.get(c), theirs.get(c)) for c in mine.keys() | theirs.keys() if mine.get(c) != theirs.get(c)}
        return f"schema {wrong}"
    left = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    right = normal_rows(relation.columns, relation.fetchall())
    if left == right:
        return "" if left else "no rows"
    extra = sorted(set(left) - set(right))[:2]
    missing = sorted(set(right) - set(left))[:2]
    return f"rows {len(left)} vs {len(right)}; only spark {extra}; only sql {missing}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import local_session

    sf_dir, names = sys.argv[1], set(sys.argv[2:])
    spark, con, bad = local_session(), connect(sf_dir), 0
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            found = compare(fn(spark, sf_dir), con, oracle_sql()[name]) if name in oracle_sql() else "no SQL"
        except Exception as error:  # report every query, not only the first that fails
            found = "error " + str(error)[:600]
        bad += bool(found)
        print(f"{'ok  ' if not found else 'FAIL'} {name:32s} {time.time() - start:6.2f}s {found}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))

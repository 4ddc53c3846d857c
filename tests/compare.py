"""Run catalogue queries and their SQL on the same parquet files and compare the rows.

    python -m tests.compare [sf folder] [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def family(value) -> str:
    return type(value).__name__


def canonical(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    table = df.select(*names).toArrow()
    return names, list(zip(*[column.to_pylist() for column in table.columns], strict=True))


def rows_of_sql(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(row[i] for i in order) for row in result.fetchall()]


def difference(mine, theirs) -> str | None:
    """Why two results differ, or None."""
    (names_a, a), (names_b, b) = mine, theirs
    if names_a != names_b:
        return f"columns {names_a} and {names_b}"
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)} rows"
    left = Counter(tuple(canonical(v) for v in row) for row in a)
    right = Counter(tuple(canonical(v) for v in row) for row in b)
    if left != right:
        only_a, only_b = list((left - right).elements()), list((right - left).elements())
        return f"{len(only_a)} rows differ, for example {str(sorted(only_a, key=str)[:2])[:900]} and {str(sorted(only_b, key=str)[:2])[:900]}"
    for i, name in enumerate(names_a):
        kinds_a = {family(row[i]) for row in a if row[i] is not None}
        kinds_b = {family(row[i]) for row in b if row[i] is not None}
        if kinds_a != kinds_b:
            return f"{name}: {kinds_a} and {kinds_b}"
    return None


def main(sf_dir: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry

    from docloom.session import local_session

    spark = local_session("8")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            start = time.time()
            mine = rows_of_spark(run(spark, sf_dir))
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name}: {len(mine[1])} rows, {took:.1f} s", flush=True)
                continue
            start = time.time()
            why = difference(mine, rows_of_sql(con, sql[name]))
            note = f"{len(mine[1])} rows, {took:.1f} s, sql {time.time() - start:.1f} s"
        except Exception as error:  # noqa: BLE001
            why, note = f"{type(error).__name__}: {str(error)[:1500]}", ""
        failed += why is not None
        print(f"{'ok   ' if why is None else 'FAIL '} {name}: {note} {why or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, sys.argv[2:]) else 0)

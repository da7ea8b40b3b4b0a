"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, bool):
        return value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


_FAMILY = {
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int", "double": "float",
    "float": "float", "string": "text", "varchar": "text", "boolean": "bool", "json": "text", "utinyint": "int",
}


def compare(spark, con, sf_dir: str, query, sql: str | None):
    """(problem or None, rows, seconds)"""
    start = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return None, len(rows), seconds
    result = con.execute(sql)
    types = {c[0]: str(c[1]).lower() for c in result.description}
    expected = result.fetchall()
    columns_a, a = _rows(df.columns, rows)
    columns_b, b = _rows(list(types), expected)
    if columns_a != columns_b:
        return f"columns {columns_a} != {columns_b}", len(rows), seconds
    for name, kind in df.dtypes:
        left, right = _FAMILY.get(kind, kind), _FAMILY.get(types[name], types[name])
        if left != right:
            return f"type of {name}: {kind} != {types[name]}", len(rows), seconds
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"{len(rows)} != {len(expected)} rows; spark only {only_a}; sql only {only_b}; {columns_a}", len(rows), seconds
    return None, len(rows), seconds


def main() -> int:
    import __spark_entry__ as entry
    from rolloom.session import get_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    wanted = sys.argv[2:]
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            problem, rows, seconds = compare(spark, con, sf_dir, query, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            problem, rows, seconds = f"{type(error).__name__}: {str(error)[:900]}", 0, 0.0
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} rows={rows} {seconds:.2f}s"
              f"{'' if name in oracles else ' (no sql)'} {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())

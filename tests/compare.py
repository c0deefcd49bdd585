"""Runs registered queries and their SQL side by side: python -m tests.compare DIR [NAME...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(root).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(value):  # noqa: ANN001, ANN201
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return str(value)


def rows(columns: list[str], data: list) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def compare(spark, con, query, sql: str, root: str) -> str:  # noqa: ANN001
    df = query(spark, root)
    ours = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if ours != theirs:
        a, b = [x for x in ours if x not in set(theirs)][:3], [x for x in theirs if x not in set(ours)][:3]
        return f"{len(ours)} rows against {len(theirs)}; only here {a}; only there {b}"
    return ""


def main(args: list[str]) -> int:
    import __spark_entry__ as e
    from geolathe.session import get_spark

    root, names = args[0], args[1:]
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(root), 0
    sql = e.oracle_sql()
    for name, query in e.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            why = compare(spark, con, query, sql[name], root) if name in sql else f"(rows only: {query(spark, root).count()})"
        except Exception as x:  # noqa: BLE001
            why = f"error {type(x).__name__}: {str(x)[:600]}"
        bad += bool(why) and not why.startswith("(rows")
        print(f"{name}: {why or 'equal'} [{time.time() - t:.1f} s]", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

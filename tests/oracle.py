"""Compare registered queries with their SQL twins in DuckDB.

``python tests/oracle.py [sf] [name-prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_cell(t[i]) for i in order) for t in tuples]
    return [columns[i] for i in order], sorted(rows, key=repr)


def compare(spark, name, fn, sql, sf_dir, con):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    exp_cols, exp = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got_cols != exp_cols:
        return f"columns differ: {got_cols} vs {exp_cols}"
    if len(got) != len(exp):
        return f"row counts differ: {len(got)} vs {len(exp)}"
    bad = [(g, e) for g, e in zip(got, exp, strict=True) if g != e]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; first {got_cols}\n   got {bad[0][0]}\n   exp {bad[0][1]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tapeloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                message = compare(spark, name, fn, oracles[name], sf_dir, con)
            else:
                n = len(fn(spark, sf_dir).collect())
                message = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            message = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += message is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if message else 'ok  '} {name} [{kind}] {time.time() - start:.2f}s {message or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())

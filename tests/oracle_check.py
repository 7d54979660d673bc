"""Run registered queries beside their SQL: python tests/oracle_check.py [table folder] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    try:
        return float(value) if not isinstance(value, (str, bytes)) and hasattr(value, "__float__") else value
    except (TypeError, ValueError):
        return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(df, con, sql):
    """None when both sides agree, otherwise what differs."""
    left_columns, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    right_columns, right = rows_of([d[0] for d in result.description], result.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} vs {right_columns}"
    if len(left) != len(right):
        return f"{len(left)} rows vs {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from relvec.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con, sqls, failures = local_session("check", **{"spark.checkpoint.dir": os.environ.get("CHECKPOINT_DIR", "/tmp/checkpoints")}), connect(folder), oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            df = queries()[name](spark, folder)
            problem = compare(df, con, sqls[name]) if name in sqls else (None if df.count() else "no rows")
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if name in sqls else "rows"
        failures += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:4} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - failures} of {len(names)} agree")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())

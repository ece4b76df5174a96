"""Compare registered queries with their oracles: ``python tests/check_oracles.py SF_DIR [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, as sorted comparable tuples."""
    frame = frame[sorted(frame.columns)]
    cells = []
    for row in frame.itertuples(index=False):
        cells.append(tuple(None if v is None or v is pd.NA or v != v else
                           float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else
                           v.item() if hasattr(v, "item") else v for v in row))
    return sorted([tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in cells],
                  key=lambda r: [(v is not None, str(v)) for v in r])


def compare(name: str, got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    left, right = normal(got), normal(want)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[0]} != {bad[1 if len(bad) > 1 else 0][1]}"[:900] if bad else None


def main() -> int:
    from tidewheel.catalog import QUERIES
    from tidewheel.session import build_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                          spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        q = QUERIES[name]
        begin = time.time()
        try:
            got = q.run(spark, folder).toPandas()
            took = time.time() - begin
            begin = time.time()
            problem = compare(name, got, duck(folder).execute(q.sql).df()) if q.sql else None
            print(f"{'FAIL' if problem else 'ok  '} {name:28s} rows={len(got):6d} spark={took:6.2f} "
                  f"duck={time.time() - begin:5.2f} {problem or ''}", flush=True)
        except Exception:
            problem = "error"
            print(f"FAIL {name}", "".join(traceback.format_exc()[-1500:]), flush=True)
        failed += problem is not None
    print("failed:", failed, "of", len(names))
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

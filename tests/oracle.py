"""Run registered queries and their SQL side by side.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TESTDATA = Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _sortable(row):
    return tuple((v is None, str(type(v)), v if v is not None else "") for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12)
    return type(a) is type(b) and a == b


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    got = spark_df.collect()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    order = sorted(names)
    left = sorted((tuple(r[n] for n in order) for r in got), key=_sortable)
    index = [names.index(n) for n in order]
    right = sorted((tuple(r[i] for i in index) for r in expected), key=_sortable)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if not all(_same(x, y) for x, y in zip(a, b)):
            bad = [(n, x, y) for n, x, y in zip(order, a, b) if not _same(x, y)]
            return f"first difference {bad} in {a}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from tradelake.session import local_session

    folder = argv[0] if argv else str(TESTDATA / "sf0.01")
    spark = local_session("8")
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem, note = compare(df, con, oracles[name]), f"{len(df.columns)} columns"
            else:
                problem, note = None, f"no oracle, {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            problem, note = f"{type(e).__name__}: {str(e)[:1500]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Comparison of a registered query with its SQL counterpart, also as a script:

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, Decimal):
        return float(v) if v % 1 else int(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(con, spark, name: str, query, sql: str, sf_dir: str) -> str | None:
    """What differs, or None."""
    df = query(spark, sf_dir)
    s_names, s_rows = _rows(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    d_names, d_rows = _rows([d[0] for d in con.description], con.fetchall())
    if s_names != d_names:
        return f"columns {s_names} != {d_names}"
    if len(s_rows) != len(d_rows):
        return f"rows {len(s_rows)} != {len(d_rows)}; first {s_rows[:2]} / {d_rows[:2]}"
    if not s_rows:
        return "no rows"
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    return f"{len(bad)} of {len(s_rows)} rows differ, first spark={bad[0][0]} sql={bad[0][1]}" if bad else None


def main() -> None:
    from conftest import make_session
    import __spark_entry__ as e
    spark = make_session()
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, failed = duck(sf_dir), 0
    queries, sqls = e.queries(), e.oracle_sql()
    for name in names or queries:
        t = time.time()
        try:
            if name in sqls:
                problem = compare(con, spark, name, queries[name], sqls[name], sf_dir)
            else:
                problem = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as ex:  # noqa: BLE001
            problem = f"{type(ex).__name__}: {str(ex)[:1500]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{len(names or queries)} queries, {failed} failed")


if __name__ == "__main__":
    main()

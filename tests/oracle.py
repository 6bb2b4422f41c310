"""Side-by-side check of registered queries against DuckDB.

Run as a script: python tests/oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


STRICT = False


def canon(v):
    """Comparable form; strict keeps the type and every digit."""
    if v is None:
        return None
    if STRICT and not isinstance(v, (list, tuple)):
        return (type(v).__name__, repr(v))
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return f"{f:.6g}" if abs(f) > 1e-9 else "0"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    return str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, build, sql, sf_dir):
    """(row count, problem or None)."""
    df = build(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), None
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    if sorted(cols) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = bag(df.columns, got), bag(cols, want)
    if a != b:
        miss, extra = b - a, a - b
        return len(got), (
            f"rows {len(got)} vs {len(want)}; {sum(miss.values())} differ; cols {sorted(cols)}\n"
            f"   missing {list(miss)[:2]}\n   extra {list(extra)[:2]}"
        )
    return len(got), None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from rangelake.session import build_session

    sf = sys.argv[1]
    pick = [a for a in sys.argv[2:] if a != "--strict"]
    STRICT = "--strict" in sys.argv
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, build in qs.items():
        if pick and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in pick):
            continue
        t = time.time()
        try:
            n, problem = compare(spark, con, name, build, sqls.get(name), sf)
        except Exception as e:  # report and go on
            n, problem = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in sqls else "rows")
        print(f"{mark} {name:34s} {n:8d} rows {time.time() - t:6.1f}s {problem or ''}", flush=True)
    print("failed:", bad)

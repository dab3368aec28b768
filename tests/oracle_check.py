"""Run registered queries beside their oracles and compare the rows.

``python tests/oracle_check.py SF_DIR [NAME ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import duckdb

from boxtally.plans.fixtures import GIVEN


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, entry, sf_dir):
    """None when equal, else a short report. Without an oracle only runs the query."""
    df = entry.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if entry.sql is None:
        return None if got else "no rows"
    cur = con.execute(entry.sql)
    names = [c[0] for c in cur.description]
    want = [tuple(r) for r in cur.fetchall()]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return None if not bad else f"{len(bad)} of {len(a)} rows differ\n   {bad[0][0]}\n   {bad[0][1]}"


if __name__ == "__main__":
    import __spark_entry__ as entry_points
    from boxtally.plans.catalog import REGISTRY
    from boxtally.session import local_session

    entry_points.queries()
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, e in REGISTRY.items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            report = compare(spark, con, e, sf_dir)
        except Exception as ex:  # noqa: BLE001
            report = f"{type(ex).__name__}: {str(ex)[:700]}"
        failed += report is not None
        print(f"{'ok  ' if report is None else 'BAD '} {name} {time.time() - t:.1f}s"
              f"{'' if e.sql else ' (no oracle)'} {report or ''}", flush=True)
    print(f"{failed} failed")

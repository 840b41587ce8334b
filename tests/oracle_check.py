"""Run registered queries against DuckDB: python tests/oracle_check.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql):
    """(ok, seconds, note)"""
    start = time.time()
    df = fn(spark, sf_dir)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return True, took, f"rows only: {len(got[1])}"
    cursor = con.execute(sql)
    want = normal([d[0] for d in cursor.description], cursor.fetchall())
    if got == want:
        return True, took, f"{len(got[1])} rows"
    if got[0] != want[0]:
        return False, took, f"columns {got[0]} != {want[0]}"
    only_got = [r for r in got[1] if r not in set(want[1])][:3]
    only_want = [r for r in want[1] if r not in set(got[1])][:3]
    return False, took, f"rows {len(got[1])} vs {len(want[1])}; spark {only_got}; sql {only_want}"


def main() -> int:
    import __spark_entry__ as entry_module
    from tallyferry.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry_module.oracle_sql()
    bad = 0
    for name, fn in entry_module.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, took, note = compare(spark, con, sf_dir, fn, sqls.get(name))
        except Exception as error:  # report and go on with the next query
            ok, took, note = False, 0.0, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {took:6.2f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())

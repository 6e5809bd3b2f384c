"""Runs a registered query and its SQL side by side and compares the rows."""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

import duckdb

from harmattan.plans.views import BASE_TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def canonical(value):
    if value is None:
        return "∅"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    import __spark_entry__ as entry

    started = time.time()
    df = entry.queries()[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return False, f"{len(mine)} rows, no SQL, {took:.1f}s"
    if not mine:
        return False, "no rows"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    kinds = {k for _, k in df.dtypes if k.startswith("decimal") or k == "interval"}
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return False, f"{len(mine)} vs {len(theirs)} rows; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    return True, f"{len(mine)} rows, {took:.1f}s" + (f" (has {kinds})" if kinds else "")


if __name__ == "__main__":
    from harmattan.session import local_session
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    wanted = sys.argv[1:]
    bad = 0
    for name in entry.queries():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, sf, name)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print("failures:", bad)

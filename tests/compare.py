"""Compare a query with its check text: same columns, same rows in any order."""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(path: str):
    con = duckdb.connect()
    con.execute("set threads=8")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    return con


def cell(v) -> str:
    if v is None:
        return "∅"
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(cell(x) for x in v) + "]"
    try:
        if pd.isna(v):
            return "∅"
    except (TypeError, ValueError):
        pass
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "as_tuple"):
        v = float(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return f"{v:.6g}" if v != int(v) or abs(v) > 1e15 else str(int(v))
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted(zip(*[[cell(v) for v in frame[c].tolist()] for c in cols])) if len(cols) else []


def compare(spark, con, name, fn, sql, path):
    start = time.time()
    got = fn(spark, path).toPandas()
    spent = time.time() - start
    if sql is None:
        return f"rows-only n={len(got)}", spent, len(got) >= 0
    start = time.time()
    want = con.execute(sql).df()
    duck_spent = time.time() - start
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} vs {sorted(want.columns)}", spent, False
    a, b = rows(got), rows(want)
    if a == b:
        return f"ok n={len(a)} duck={duck_spent:.1f}", spent, True
    set_a, set_b = set(a), set(b)
    only_a = [r for r in a if r not in set_b][:3]
    only_b = [r for r in b if r not in set_a][:3]
    return f"DIFF {len(a)} vs {len(b)}\n   spark {only_a}\n   check {only_b}", spent, False


if __name__ == "__main__":
    import __spark_entry__ as entry
    from auditlake.session import local_session

    path = "/root/testdata/sf0.01"
    wanted = sys.argv[1:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(path)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in q:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            msg, spent, ok = compare(spark, con, name, q[name], o.get(name), path)
        except Exception as e:  # noqa: BLE001
            msg, spent, ok = "ERROR " + str(e)[:900], 0.0, False
            if "--trace" in sys.argv:
                traceback.print_exc()
        bad += not ok
        print(f"{name:24s} {spent:6.1f}s {msg}", flush=True)
    print("bad:", bad)

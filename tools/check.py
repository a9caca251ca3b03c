"""Run registered queries next to their SQL twins: ``python tools/check.py --sf 0.01 [name ...]``."""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pagemill.plans import TABLES, Tables, load_all  # noqa: E402
from pagemill.session import build_session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6g}" if abs(value) >= 1e-9 else "0"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in value.items()) + "}"
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, con, q, folder):
    started = time.time()
    df = q.build(Tables(spark, folder))
    rows = [tuple(r) for r in df.collect()]
    spark_secs = time.time() - started
    if q.sql is None:
        return "rows", len(rows), spark_secs, 0.0, ""
    started = time.time()
    rel = con.execute(q.sql)
    names = [d[0] for d in rel.description]
    expected = rel.fetchall()
    sql_secs = time.time() - started
    got_cols, got = table(df.columns, rows)
    want_cols, want = table(names, expected)
    if got_cols != want_cols:
        return "COLUMNS", len(rows), spark_secs, sql_secs, f"{got_cols} != {want_cols}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        detail = f"rows {len(got)}/{len(want)}\n   spark {str(only_got)[:1500]}\n   sql   {str(only_want)[:1500]}"
        return "VALUES", len(rows), spark_secs, sql_secs, detail
    return "ok", len(rows), spark_secs, sql_secs, ""


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--module")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    if args.module:
        import importlib

        for m in args.module.split(","):
            importlib.import_module(f"pagemill.plans.{m}")
        from pagemill.plans import REGISTRY as registry
    else:
        registry = load_all()
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in args.names or registry:
        try:
            status, n, a, b, detail = compare(spark, con, registry[name], folder)
        except Exception as exc:  # noqa: BLE001
            status, n, a, b, detail = "ERROR", -1, 0.0, 0.0, f"{type(exc).__name__}: {str(exc)[:1500]}"
        flag = "  " if status in ("ok", "rows") else "!!"
        bad += flag == "!!"
        print(f"{flag} {name:32s} {status:8s} rows={n:<7d} spark={a:6.2f}s sql={b:5.2f}s {detail}", flush=True)
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())

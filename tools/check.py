"""Run registered queries against their SQL on one folder: ``python tools/check.py FOLDER [name-prefix ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from meterloom.plans.catalog import load
from meterloom.session import build_session

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in at) for r in rows), key=repr)


def main(folder: str, prefixes: list[str]) -> int:
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    bad = 0
    for name, q in load().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        begin = time.time()
        try:
            df = q(spark, folder)
            got = rows_of(df.columns, df.collect())
            took = time.time() - begin
            note = f"{len(got)} rows {took:.1f}s"
            if q.sql is None:
                print(f"rows   {name}: {note}", flush=True)
                continue
            begin = time.time()
            cur = con.execute(q.sql)
            want = rows_of([c[0] for c in cur.description], cur.fetchall())
            note += f", sql {time.time() - begin:.1f}s"
            if sorted(df.columns) != sorted(c[0] for c in con.description):
                bad += 1
                print(f"FAIL   {name}: columns {sorted(df.columns)} vs {sorted(c[0] for c in con.description)}", flush=True)
            elif got != want:
                bad += 1
                off = [(g, w) for g, w in zip(got, want) if g != w][:3]
                print(f"FAIL   {name}: {note}, want {len(want)} rows; first differences {off}", flush=True)
            else:
                print(f"ok     {name}: {note}", flush=True)
        except Exception as error:
            bad += 1
            print(f"ERROR  {name}: {type(error).__name__}: {str(error)[-700:]}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)

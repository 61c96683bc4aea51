"""Run registered queries in Spark and their SQL in DuckDB and compare the rows. ``python tests/compare.py [names]``."""

from __future__ import annotations

import math
import os
import sys
import threading
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(norm(x) for x in v.values())
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def check(spark, con, sf_dir, fn, sql):
    """None if equal, else a message; also seconds on both sides."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return None if got else "no rows", len(got), t1 - t0, 0.0
    timer = threading.Timer(60, con.interrupt)
    timer.start()
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    timer.cancel()
    msg = None
    if got_cols != want_cols:
        msg = f"columns {got_cols} vs {want_cols}"
    elif got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        msg = f"rows {len(got)} vs {len(want)}; first differences {diff}"
    return msg, len(got), t1 - t0, t2 - t1


def main(names):
    import __spark_entry__ as E
    from maskquery.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(), duck(sf)
    spark.sparkContext.setLogLevel("ERROR")
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or qs:
        if name.endswith("*"):
            picked = [q for q in qs if q.startswith(name[:-1])]
        else:
            picked = [name]
        for q in picked:
            try:
                msg, n, ts, td = check(spark, con, sf, qs[q], os_.get(q))
            except Exception as e:  # noqa: BLE001
                msg, n, ts, td = "ERROR " + str(e)[:1500], 0, 0, 0
            bad += msg is not None
            print(f"{'OK ' if msg is None else 'BAD'} {q} rows={n} spark={ts:.1f}s duck={td:.1f}s {'' if q in os_ else '[rows only]'} {(msg or '')[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])

"""Run a registered Spark query and its SQL twin (DuckDB) on the same parquet
files and compare row count, column names and an order-insensitive value
digest. Usable from pytest and from the command line:

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [cols[i] for i in order], out


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
                 "smallint": "SMALLINT", "float": "FLOAT"}


def compare(spark, con, sf_dir, name, query, sql):
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_types = dict(sdf.dtypes)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sc, sr = _rows(s_cols, s_rows)
    dc, dr = _rows(d_cols, d_rows)
    problems = []
    if sc != dc:
        problems.append(f"columns spark={sc} oracle={dc}")
    else:
        diff = [(c, s_types[c], d_types.get(c)) for c in s_cols
                if SPARK_TO_DUCK.get(s_types[c], s_types[c]) != d_types.get(c)]
        if diff:
            problems.append(f"types differ {diff}")
    if len(sr) != len(dr):
        problems.append(f"rows spark={len(sr)} oracle={len(dr)}")
    elif sr != dr:
        diff = [(a, b) for a, b in zip(sr, dr) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return {"name": name, "ok": not problems, "rows": len(sr), "spark_sec": round(t1 - t0, 2),
            "problems": problems}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from staylens.session import build_session
    spark = build_session("local[8]")
    con = duck(sf_dir)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or list(qs):
        if name not in oracle:
            df = qs[name](spark, sf_dir)
            print(f"{name}: rows-only {df.count()}")
            continue
        try:
            r = compare(spark, con, sf_dir, name, qs[name], oracle[name])
        except Exception as e:  # report and continue
            r = {"name": name, "ok": False, "problems": [repr(e)[:500]]}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "FAIL"), name, r.get("rows"), r.get("spark_sec"),
              "; ".join(r["problems"]))
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)

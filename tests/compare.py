"""Run registered queries next to their SQL twins: ``python tests/compare.py [-s 0.01] [names]``."""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FAMILY = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "double": "double",
          "float": "float", "string": "str", "boolean": "bool", "date": "date"}
DUCK = {"TINYINT": "int8", "SMALLINT": "int16", "INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "double",
        "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool", "DATE": "date"}


def connect(d: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


TIMES: dict[str, float] = {}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=lambda r: tuple(str(x) for x in r))


def compare(spark, con, name, fn, sql, d):
    """None when equal, else a short description of the first difference."""
    df = fn(spark, d)
    t = time.time()
    got = [tuple(r) for r in df.collect()]
    TIMES[name] = time.time() - t
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    types = [str(c[1]) for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}"
    st = dict(df.dtypes)
    odd = [f"{c}:{st[c]}/{t}" for c, t in zip(cols, types) if FAMILY.get(st[c], st[c]) != DUCK.get(t, t)]
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{sorted(cols)}: {x} vs {y} ({sum(p != q for p, q in zip(a, b))} of {len(a)} differ)"
    if not a:
        return "no rows"
    return f"types {odd}" if odd else None


def session(cores: int = 8, name: str = "checks"):
    from pyspark.sql import SparkSession

    from canopygrid.session import tune

    b = tune(SparkSession.builder.master(f"local[{cores}]").appName(name))
    spark = (b.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checks-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    import __spark_entry__ as E

    ap = argparse.ArgumentParser()
    ap.add_argument("-s", default="0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    d = f"/root/testdata/sf{a.s}"
    spark, con = session(), connect(d)
    oracle = E.oracle_sql()
    bad = 0
    for name, fn in E.queries().items():
        if a.names and name not in a.names:
            continue
        t = time.time()
        try:
            msg = compare(spark, con, name, fn, oracle.get(name), d)
        except Exception as ex:  # noqa: BLE001
            msg = f"{type(ex).__name__}: {str(ex)[:600]}"
        bad += msg is not None
        print(f"{'ok ' if msg is None else 'BAD'} {name:22s} {TIMES.get(name, 0):6.2f}s of {time.time()-t:6.2f}s {'' if name in oracle else '(rows only) '}{msg or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()

"""Run registered queries beside their SQL twins and compare whole results."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    out = []
    for rec in df.itertuples(index=False, name=None):
        out.append(tuple(norm(v) for v in rec))
    return sorted(out, key=repr)


def norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return norm_seq(v.tolist() if hasattr(v, "tolist") else v)
    if isinstance(v, float):
        return None if v != v else (int(v) if v == int(v) and abs(v) < 1e15 else v + 0.0)
    return v


def norm_seq(v):
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else norm(v)


def kind(dtype: str) -> str:
    d = str(dtype).lower()
    for k, names in {"int": ("int", "long"), "float": ("float", "double"), "bool": ("bool",)}.items():
        if any(n in d for n in names):
            return k
    return d


def compare(got: pd.DataFrame, want: pd.DataFrame, tol: float = 0.0) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows(got), rows(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)}/{len(a)} rows differ, first {bad[0]}"
    return "ok"


def check(spark, con, name: str, sf_dir: str, queries, sql) -> tuple[str, float, int]:
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    names = [f.name for f in df.schema]
    got = pd.DataFrame([tuple(x) for x in df.collect()], columns=names, dtype=object)
    took = time.time() - t0
    if name not in sql:
        return ("rows-only" if len(got) else "EMPTY"), took, len(got)
    rel = con.sql(sql[name])
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)
    types = dict(zip(rel.columns, map(str, rel.types)))
    res = compare(got, want)
    if res == "ok":
        odd = [f"{f.name}:{f.dataType.simpleString()}/{types[f.name]}" for f in df.schema
               if simple(f.dataType.simpleString()) != simple(types[f.name])]
        if odd:
            res = f"types {odd}"
        elif not len(got):
            res = "ok-EMPTY"
    return res, took, len(got)


def simple(t: str) -> str:
    t = t.lower()
    table = {"varchar": "string", "integer": "int", "int32": "int", "boolean": "boolean"}
    return table.get(t, t)


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
             .config("spark.log.level", "ERROR")
             .getOrCreate())
    if os.environ.get("BLOCK_ROWS"):
        spark.conf.set("spark.lapforge.blockRows", os.environ["BLOCK_ROWS"])
    con = connect(sf)
    qs, sql = entry.queries(), entry.oracle_sql()
    want = sys.argv[1:]
    names = [n for n in qs if not want or any(n.startswith(w) for w in want)]
    bad = []
    for n in names:
        try:
            res, took, cnt = check(spark, con, n, sf, qs, sql)
        except Exception as ex:  # report and go on
            res, took, cnt = f"ERROR {type(ex).__name__} {str(ex)[:600]}", 0.0, 0
        if res not in ("ok", "rows-only"):
            bad.append(n)
        print(f"{n:12s} {took:6.2f}s {cnt:7d} {res[:900]}", flush=True)
    print("checked", len(names), "bad", bad)

"""Driver-style check: run a registered Spark job and its DuckDB oracle on the
same parquet tables; compare row count, column names and an order-insensitive
value hash (columns sorted by name)."""

from __future__ import annotations

import hashlib
import math
import sys

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        # a whole-number column with nulls may come as floats
        return int(v) if v.is_integer() else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def frame_hash(pdf: pd.DataFrame) -> str:
    cols = sorted(pdf.columns)
    rows = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in pdf.to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark, key: str, sf_dir: str, con=None) -> dict:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E
    con = con or duck(sf_dir)
    sdf = E.queries()[key](spark, sf_dir)
    s_pdf = sdf.toPandas()
    out = {"key": key, "spark_rows": len(s_pdf), "spark_cols": sorted(s_pdf.columns)}
    sql = E.oracle_sql().get(key)
    if sql is None:
        out["oracle"] = None
        return out
    o_pdf = con.execute(sql).df()
    out.update(oracle_rows=len(o_pdf), oracle_cols=sorted(o_pdf.columns))
    out["cols_match"] = out["spark_cols"] == out["oracle_cols"]
    out["rows_match"] = len(s_pdf) == len(o_pdf)
    out["hash_match"] = out["cols_match"] and frame_hash(s_pdf) == frame_hash(o_pdf)
    if not out["hash_match"] and out["cols_match"]:
        cols = sorted(s_pdf.columns)
        a = set(repr(tuple(_norm(r[c]) for c in cols)) for r in s_pdf.to_dict("records"))
        b = set(repr(tuple(_norm(r[c]) for c in cols)) for r in o_pdf.to_dict("records"))
        out["only_spark"] = sorted(a - b)[:3]
        out["only_oracle"] = sorted(b - a)[:3]
    return out


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from intentlane.session import build_session
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or list(E.queries())
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf)
    bad = 0
    for k in keys:
        import time
        t0 = time.time()
        try:
            r = compare(spark, k, sf, con)
        except Exception as e:  # report and continue
            r = {"key": k, "error": repr(e)[:2000]}
        r["sec"] = round(time.time() - t0, 2)
        ok = bool(r.get("hash_match")) or ("oracle" in r and r["oracle"] is None and "error" not in r)
        bad += 0 if ok else 1
        print(("OK  " if ok else "FAIL"), r, flush=True)
    print("failures:", bad)

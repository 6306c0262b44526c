"""Run every query beside its SQL and compare whole results. Usage: check_sql.py [sf_dir] [name ...]"""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    out = [tuple(None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else
                 (float(v) if isinstance(v, float) else str(v)) for v in r)
           for r in pdf.astype(object).itertuples(index=False)]
    return sorted(out, key=repr)


def compare(spark, con, name, sf_dir):
    """None when equal, else a short account of the difference."""
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if a != b:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        return f"{len(a)} rows against {len(b)}; only here {sorted(sa - sb)[:2]}; only SQL {sorted(sb - sa)[:2]}"
    kinds = [f"{c}: {got[c].dtype} / {want[c].dtype}" for c in got.columns if got[c].dtype != want[c].dtype]
    return ("types differ: " + ", ".join(kinds)) if kinds and len(a) else None if a else "empty"


if __name__ == "__main__":
    from logweir.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("check", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    for name in sys.argv[2:] or entry.queries():
        began = time.time()
        try:
            problem = compare(spark, con, name, sf)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)

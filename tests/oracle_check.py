"""Compares queries with their SQL: python tests/oracle_check.py SF_DIR [NAME...]."""
from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> str:
    """Empty if both hold the same rows, else what differs."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} and {sorted(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    cols = sorted(a.columns)
    sides = [sorted(map(repr, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None))) for x in (norm(a), norm(b))]
    bad = [(x, y) for x, y in zip(*sides) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def norm(df: pd.DataFrame) -> pd.DataFrame:
    df = df.copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float).round(5) + 0.0
    return df


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    q, o, con = entry.queries(), entry.oracle_sql(), connect(sys.argv[1])
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            got = q[name](spark, sys.argv[1]).toPandas()
            print(name, len(got), "rows", round(time.time() - t, 1), "s", (same(got, con.execute(o[name]).df()) or "equal") if name in o else "no SQL", flush=True)
        except Exception as e:
            print(name, "FAILED", str(e)[:600], flush=True)

"""Run registered queries beside their SQL in DuckDB: python tests/oracle.py SF_DIR [NAME_PREFIX...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [tuple(None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else v.item() if hasattr(v, "item") else v for v in row) for row in df.itertuples(index=False)]
    return sorted(rows, key=repr)


def difference(spark_df, con, sql: str) -> str:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y and [None if v is None else float(v) if isinstance(v, (int, float)) else v for v in x] != [None if v is None else float(v) if isinstance(v, (int, float)) else v for v in y]]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


def session():
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = ROOT
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as e

    sf_dir, prefixes = sys.argv[1], sys.argv[2:]
    spark, con, sqls = session(), connection(sys.argv[1]), e.oracle_sql()
    for name, f in e.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            said = difference(f(spark, sf_dir), con, sqls[name]) if name in sqls else f"{f(spark, sf_dir).count()} rows, no SQL"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:300]}"
        print(f"{'ok ' if not said else '-- '}{name} {time.time() - t:.1f}s {said}", flush=True)

"""Compare queries with their SQL on the driver tables: python tests/oracle.py [NAME...]."""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if isinstance(v, float):
            return round(v, 9)
        if hasattr(v, "tolist"):
            return plain_list(v.tolist())
        if isinstance(v, list):
            return plain_list(v)
        if isinstance(v, pd.Timestamp):
            return v.tz_localize(None).isoformat() if v.tzinfo else v.isoformat()
        return v

    def plain_list(v):
        return tuple(plain(x) for x in v) if isinstance(v, list) else plain(v)

    df = df[sorted(df.columns)]
    return sorted(([plain(v) for v in r] for r in df.astype(object).itertuples(index=False)), key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"{len(a)} and {len(b)} rows; first differences {bad}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype) and not got[c].isna().any()}
    return f"types {kinds}" if any("float" in x for k in kinds.values() for x in k) and any("int" in x for k in kinds.values() for x in k) else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = connect(sf_dir), e.queries(), e.oracle_sql()
    for name in sys.argv[1:] or sorted(q):
        began = time.time()
        try:
            said = compare(spark, con, name, q[name], o[name], sf_dir) if name in o else f"no SQL; {q[name](spark, sf_dir).count()} rows"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)

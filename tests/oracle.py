"""Runs a query and its SQL side by side: python tests/oracle.py [sf_dir] [name ..]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, connection, sf_dir, name, query, sql):
    began = time.time()
    got = query(spark, sf_dir).toPandas()
    t_spark, began = time.time() - began, time.time()
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL ({t_spark:.1f} s)", True
    want = connection.execute(sql).df()
    t_sql = time.time() - began
    order = sorted(want.columns)
    if sorted(got.columns) != order:
        return f"{name}: columns {sorted(got.columns)} and {order}", False
    rows = lambda x: sorted(map(repr, x[order].astype(object).where(x[order].notna(), None).itertuples(index=False, name=None)))
    a, b = rows(got), rows(want)
    if a != b:
        odd = next(((x, y) for x, y in zip(a, b) if x != y), (len(a), len(b)))
        return f"{name}: rows differ: {odd}", False
    return f"{name}: {len(a)} rows agree ({t_spark:.1f} s, SQL {t_sql:.1f} s)", True


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    c, bad = connect(sf_dir), 0
    for name, q in e.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            said, ok = compare(spark, c, sf_dir, name, q, e.oracle_sql().get(name))
        except Exception as x:
            said, ok = f"{name}: {type(x).__name__} {str(x)[:400]}", False
        bad += not ok
        print("ok " if ok else "BAD", said, flush=True)
    sys.exit(bad > 0)

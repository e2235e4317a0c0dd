"""Run queries next to their SQL on one folder: python tests/check_oracles.py FOLDER [names…]."""

import datetime as dt
import math
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def open_oracle(folder):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}".rstrip("0")
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def compare(spark_rows, spark_cols, oracle_rows, oracle_cols):
    """None when equal, else a short description."""
    if sorted(spark_cols) != sorted(oracle_cols):
        return f"columns {sorted(spark_cols)} != {sorted(oracle_cols)}"
    if len(spark_rows) != len(oracle_rows):
        return f"{len(spark_rows)} rows != {len(oracle_rows)}"

    def shaped(rows, cols):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple(repr(canonical(r[i])) for i in order) for r in rows)

    left, right = shaped(spark_rows, spark_cols), shaped(oracle_rows, oracle_cols)
    for a, b in zip(left, right):
        if a != b:
            return f"values {sorted(spark_cols)}: {a} != {b}"
    return None


def check(spark, con, name, fn, sql, folder):
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(rows), None
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return len(rows), compare(rows, df.columns, cur.fetchall(), cols)


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], set(sys.argv[2:])
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = open_oracle(folder), entry.oracle_sql()

    def run(item):
        name, fn = item
        start = time.time()
        try:
            n, problem = check(spark, con.cursor(), name, fn, sqls.get(name), folder)
        except Exception as e:  # noqa: BLE001
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        state = "BAD" if problem else ("ok" if name in sqls else "rows")
        print(f"\n{state:5}{name:28}{n:8} rows {time.time() - start:6.1f}s {problem or ''}", flush=True)
        return problem is not None

    chosen = [(n, f) for n, f in entry.queries().items() if not wanted or n in wanted]
    with ThreadPoolExecutor(4) as pool:
        bad = sum(pool.map(run, chosen))
    print("problems:", bad, "of", len(chosen))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

"""Run queries at a scale factor against their SQL twins and report differences.

    python tools/check.py [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stratalens-"))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return repr(float(f"{value:.12g}") + 0.0)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    from workload.oracle import ORACLE
    from workload.queries import QUERIES

    folder = f"/root/testdata/sf{args.sf}"
    spark, db = session(), duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = []
    for key in args.keys or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[key](spark, folder)
            got = df.collect()
        except Exception as err:
            print(f"FAIL {key}: {str(err)[:600]}", flush=True)
            bad.append(key)
            continue
        took = time.time() - start
        if key not in ORACLE:
            print(f"rows {key}: {len(got)} rows {took:.2f}s (no SQL) {df.columns}", flush=True)
            continue
        try:
            cur = db.execute(ORACLE[key])
            names = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            want = cur.fetchall()
        except Exception as err:
            print(f"SQL  {key}: {str(err)[:600]}", flush=True)
            bad.append(key)
            continue
        spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
        odd = {
            n: (t, types.get(n))
            for n, t in spark_types.items()
            if {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(t) != types.get(n)
        }
        a, b = rows_of(df.columns, got), rows_of(names, want)
        same = sorted(df.columns) == sorted(names) and a == b and len(a) > 0 and not odd
        print(f"{'ok  ' if same else 'DIFF'} {key}: {len(a)} rows, SQL {len(b)}, {took:.2f}s {odd or ''}", flush=True)
        if not same:
            bad.append(key)
            if sorted(df.columns) != sorted(names):
                print("   columns", sorted(df.columns), sorted(names))
            sa, sb = set(a), set(b)
            print("   only Spark", [r for r in a if r not in sb][:3])
            print("   only SQL  ", [r for r in b if r not in sa][:3])
    print("not equal:", bad)
    spark.stop()


if __name__ == "__main__":
    main()

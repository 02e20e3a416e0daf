"""Run registered queries beside their DuckDB SQL and compare the rows.

Usage: python tests/compare.py FOLDER [QUERY ...]
"""

import hashlib
import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from commitlens.sources.testdata import BASE


def connect(folder):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.6f}".rstrip("0").rstrip(".")
    return "null" if value is None else str(value)


def digest(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = sorted("\x1f".join(_cell(row[i]) for i in order) for row in rows)
    return len(cells), hashlib.md5("\x1e".join(cells).encode()).hexdigest(), cells


def compare(spark, con, folder, run, sql):
    started = time.time()
    frame = run(spark, folder)
    rows = frame.collect()
    spark_time = time.time() - started
    started = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    sql_time = time.time() - started
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    odd = {c: k for c, k in kinds.items() if "HUGEINT" in k or "DECIMAL" in k}
    same_columns = sorted(columns) == sorted(frame.columns)
    n, h, got = digest(rows, frame.columns)
    m, k, wanted = digest(expected, columns)
    note = str(odd or "") if same_columns else f"columns {sorted(frame.columns)} <> {sorted(columns)}"
    if same_columns and h != k:
        here, there = set(got), set(wanted)
        note = f"only spark {[x[:300] for x in sorted(here - there)[:3]]} only sql {[x[:300] for x in sorted(there - here)[:3]]}"
    return same_columns and h == k, n, m, spark_time, sql_time, note


def main(folder, names):
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.driver.maxResultSize", "4g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    runs, sqls = queries(), oracle_sql()
    bad = []
    for name in names or runs:
        if name not in sqls:
            print(f"rows {name} {runs[name](spark, folder).count()}", flush=True)
            continue
        try:
            same, n, m, a, b, note = compare(spark, con, folder, runs[name], sqls[name])
            print(f"{'ok  ' if same else 'DIFF'} {name} rows={n}/{m} spark={a:.1f}s sql={b:.1f}s {note}", flush=True)
        except Exception as error:
            same = False
            print(f"FAIL {name} {str(error)[:1200]}", flush=True)
        if not same:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

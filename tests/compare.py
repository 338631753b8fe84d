"""Run registered queries next to their SQL twins in DuckDB.

``python tests/compare.py SF_DIR [name ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(rows, columns):
    """Rows with columns by name, sorted; whole-valued types kept apart from doubles."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda t: tuple((v is None, type(v).__name__, str(v)) for v in t))


def difference(spark_df, con, sql) -> str | None:
    names, left = normal([tuple(r) for r in spark_df.collect()], spark_df.columns)
    con.execute(sql)
    columns = [d[0] for d in con.description]
    other, right = normal(con.fetchall(), columns)
    if names != other:
        return f"columns {names} != {other}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if repr(a) != repr(b)]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from pyspark.sql import SparkSession

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
        "spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config(
        "spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", os.environ.get("COMPARE_ZONE", "UTC"))
    con, oracles = duck(sf_dir), oracle_sql()
    failed = 0
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            found = run(spark, sf_dir)
            if name in oracles:
                problem = difference(found, con, oracles[name])
            else:
                problem = f"no SQL, {found.count()} rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:6000]}"
        failed += problem is not None
        print(f"{'OK ' if problem is None else 'BAD'} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()

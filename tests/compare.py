"""Compare a query with its SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences, empty if the two results are equal."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = _rows(names, result.fetchall())
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        problems.append(f"columns {sorted(spark_df.columns)} instead of {sorted(names)}")
    same = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for name, kind in spark_df.dtypes:
        if name in types and same.get(kind) != types[name]:
            problems.append(f"type of {name}: {kind} instead of {types[name]}")
    if want != got:
        extra, missing = list((got - want).elements()), list((want - got).elements())
        problems.append(f"{sum(got.values())} rows instead of {sum(want.values())}; extra {len(extra)}: {sorted(map(str, extra))[:3]}; "
                        f"missing {len(missing)}: {sorted(map(str, missing))[:3]}")
    return problems


def main() -> int:
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            problems = compare(queries[name](spark, sf_dir), con, oracle[name])
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n      " if problems else "", flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())

"""Compares registered queries with their SQL equivalents: `python tests/oracle_check.py [sf_dir] [name ...]`."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(columns, tuples):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(t[i]) for i in order) for t in tuples]
    return sorted(columns), sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def _kind(name: str) -> str:
    name = name.lower()
    for kinds, label in (
        (("bigint", "long", "hugeint"), "bigint" if "huge" not in name else "hugeint"),
        (("double",), "double"),
        (("int", "integer"), "int"),
        (("string", "varchar"), "string"),
        (("boolean", "bool"), "boolean"),
    ):
        if any(name.startswith(k) for k in kinds):
            return label
    return name


def compare(df, relation) -> str | None:
    """None when both hold the same rows under the same column names and types."""
    spark_types = {c: _kind(t) for c, t in df.dtypes}
    sql_types = {c: _kind(str(t)) for c, t in zip(relation.columns, relation.types)}
    if spark_types != sql_types:
        both = set(spark_types) | set(sql_types)
        return f"schema: {[(c, spark_types.get(c), sql_types.get(c)) for c in sorted(both) if spark_types.get(c) != sql_types.get(c)]}"
    columns, ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    _, theirs = _rows(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        return f"row count: {len(ours)} vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"value: {[(c, x, y) for c, x, y in zip(columns, a, b) if x != y]} in {dict(zip(columns, a))}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = connect(sf_dir), 0
    for name in names:
        begin = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            problem = compare(df, connection.sql(oracle_sql()[name]))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - begin:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} equal; without SQL: {sorted(set(queries()) - set(oracle_sql()))}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

"""Runs a registered query and its SQL oracle and compares them as multisets of rows."""

from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def oracle_rows(connection, sql: str) -> tuple[list[str], Counter]:
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    return [names[i] for i in order], rows


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(row[name] for name in names) for row in df.collect())


def differences(df, connection, sql: str) -> str | None:
    actual_names, actual = spark_rows(df)
    expected_names, expected = oracle_rows(connection, sql)
    if actual_names != expected_names:
        return f"columns {actual_names} != {expected_names}"
    if actual != expected:
        extra = list((actual - expected).items())[:2]
        missing = list((expected - actual).items())[:2]
        return f"{actual.total()} vs {expected.total()} rows; extra={extra}; missing={missing}"
    return None

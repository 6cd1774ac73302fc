"""Run registered queries against their SQL on DuckDB and compare every value."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


SAME_TYPE = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def kind(value) -> str:
    return "float" if isinstance(value, float) else type(value).__name__


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = [tuple(plain(r[i]) for i in order) for r in rows]
    return names, sorted(body, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(query, sql: str, spark, connection, sf_dir: str) -> tuple[list[str], int]:
    """Differences found (empty when equal) and the number of rows."""
    df = query(spark, sf_dir)
    names, rows = ordered(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    description = cursor.description
    wanted_names, wanted = ordered([d[0] for d in description], cursor.fetchall())
    if names != wanted_names:
        return [f"columns {names} != {wanted_names}"], len(rows)
    if len(rows) != len(wanted):
        return [f"rows {len(rows)} != {len(wanted)}"], len(rows)
    types = {d[0]: str(d[1]) for d in description}
    problems = [
        f"type of {name}: {kind_name} is not {types[name]}"
        for name, kind_name in df.dtypes
        if SAME_TYPE.get(kind_name) != types[name]
    ]
    for got, want in zip(rows, wanted):
        for name, a, b in zip(names, got, want):
            if a != b or (a is not None and kind(a) != kind(b)):
                problems.append(f"{name}: {a!r} != {b!r}")
    return problems, len(rows)


def main() -> int:
    import __spark_entry__ as entry
    from stayrate.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
    conf.update(pair.split("=", 1) for pair in os.environ.get("CHECK_CONF", "").split(",") if pair)
    spark = build_session("check", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                problems, count = compare(query, oracles[name], spark, connection, sf_dir)
            else:
                problems, count = [], query(spark, sf_dir).count()
        except Exception as error:
            problems, count = [f"{type(error).__name__}: {str(error)[:600]}"], -1
        bad += bool(problems)
        verdict = "ok" if not problems else f"BAD {len(problems)} {problems[:3]}"
        checked = "" if name in oracles else " (rows only)"
        print(f"{name}: {verdict} rows={count} {time.time() - start:.1f}s{checked}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

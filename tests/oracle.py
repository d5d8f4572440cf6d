"""Runs registered queries in Spark and DuckDB and compares the rows.

``python -m tests.oracle [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(names: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, run, sql: str | None) -> str:
    """Empty when both sides agree, else a short description of the difference."""
    frame = run(spark, sf_dir)
    names, ours = rows_of(frame.columns, frame.collect())
    if sql is None:
        return "" if ours else "no rows"
    result = con.execute(sql)
    sql_names, theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        sample = [str(next(iter(c)))[:300] if c else "-" for c in (extra, missing)]
        return f"{sum(ours.values())} vs {sum(theirs.values())} rows; only ours {sum(extra.values())} {sample[0]}; only SQL {sum(missing.values())} {sample[1]}"
    return "" if ours else "both empty"


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry

    from linkloom.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, run, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{name:28s} {time.time() - start:6.1f}s {'sql ' if name in sqls else 'rows'} {problem or 'ok'}", flush=True)
    print(f"{bad} differences")


if __name__ == "__main__":
    main()

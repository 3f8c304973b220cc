"""Run registered queries and their SQL twins side by side and compare the rows.

``python tests/oracle_check.py [--sf 0.01] [query ...]``
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(plain(row[i]) for i in order) for row in rows
    )


def duck(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def compare(spark, connection, name, function, sql, sf_dir):
    started = time.time()
    frame = function(spark, sf_dir)
    columns, rows = frame.columns, [tuple(r) for r in frame.collect()]
    spark_seconds = time.time() - started
    if sql is None:
        return True, f"rows={len(rows)} (no SQL twin) spark={spark_seconds:.1f}s"
    started = time.time()
    result = connection.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    expected = table_of([d[0] for d in result.description], result.fetchall())
    actual = table_of(columns, rows)
    note = f"rows={len(rows)} spark={spark_seconds:.1f}s duck={time.time() - started:.1f}s"
    wide = [c for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
    if wide:
        note += f" WIDE TYPES {wide}"
    if actual == expected:
        return not wide, note
    if actual[0] != expected[0]:
        return False, f"{note} columns {actual[0]} != {expected[0]}"
    only_spark, only_sql = actual[1] - expected[1], expected[1] - actual[1]
    return False, (
        f"{note} only spark {sum(only_spark.values())} {list(only_spark)[:3]} "
        f"only sql {sum(only_sql.values())} {list(only_sql)[:3]}"
    )


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    arguments = parser.parse_args()
    import __spark_entry__ as entry
    from cuesheet.plans.session import build_session

    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{arguments.sf}"
    connection = duck(sf_dir)
    oracles, failed = entry.oracle_sql(), []
    for name, function in entry.queries().items():
        if arguments.names and not any(name.startswith(n) for n in arguments.names):
            continue
        try:
            good, note = compare(spark, connection, name, function, oracles.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            good, note = False, f"{type(error).__name__}: {str(error)[-1500:]}"
        print("ok  " if good else "FAIL", name, note, flush=True)
        if not good:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())

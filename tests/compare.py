"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

``python tests/compare.py [--sf sf0.01] [prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .appName("tillwise")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=lambda row: [(v is None, str(type(v)), str(v)) for v in row])


def compare(spark, con, folder: str, key: str, query, sql: str | None):
    """None when both sides agree, else what differs. Returns (problem, rows)."""
    frame = query(spark, folder)
    rows = [tuple(row) for row in frame.collect()]
    names, ours = canonical(frame.columns, rows)
    if sql is None:
        return None, len(ours)
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    names2, theirs = canonical(theirs_names, cursor.fetchall())
    if names != names2:
        return f"columns {names} != {names2}", len(ours)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}", len(ours)
    for a, b in zip(ours, theirs):
        if a != b:
            return f"first difference\n   spark {dict(zip(names, a))}\n   sql   {dict(zip(names, b))}", len(ours)
    types1 = [type(v) for v in ours[0]] if ours else []
    types2 = [type(v) for v in theirs[0]] if theirs else []
    if types1 != types2:
        return f"types {list(zip(names, types1, types2))}", len(ours)
    return None, len(ours)


def main(argv):
    import __spark_entry__ as entry

    sf = "sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2 :]
    folder = f"/root/testdata/{sf}"
    spark, con = session(), duck(folder)
    sqls, bad = entry.oracle_sql(), []
    todo = {k: q for k, q in entry.queries().items() if not argv or any(k.startswith(p) for p in argv)}
    for key, query in todo.items():
        start = time.time()
        try:
            problem, rows = compare(spark, con, folder, key, query, sqls.get(key))
        except Exception as error:  # noqa: BLE001
            problem, rows = "error " + "".join(traceback.format_exception_only(error))[:1500], -1
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {key} rows={rows} sql={'yes' if key in sqls else 'no'} {time.time() - start:.1f}s", flush=True)
        if problem is not None:
            bad.append(key)
            print("   " + problem, flush=True)
    print(f"{len(todo) - len(bad)} ok, {len(bad)} bad: {bad}")


if __name__ == "__main__":
    main(sys.argv[1:])

"""Run registered queries on Spark and their statements on DuckDB and compare the rows."""

from __future__ import annotations

import collections
import datetime
import decimal
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def compare(spark: SparkSession, con, query, sql: str, sf_dir: str) -> tuple[bool, str]:
    started = time.time()
    frame = query(spark, sf_dir)
    names = sorted(frame.columns)
    ours = collections.Counter(
        tuple(plain(v) for v in r) for r in frame.select(*names).collect()
    )
    took = time.time() - started
    started = time.time()
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    order = [columns.index(n) for n in names] if sorted(columns) == names else None
    rows = cursor.fetchall()
    oracle_took = time.time() - started
    if order is None:
        return False, f"columns {names} != {sorted(columns)}"
    theirs = collections.Counter(tuple(plain(r[i]) for i in order) for r in rows)
    note = f"{sum(ours.values())} rows, spark {took:.1f}s, duckdb {oracle_took:.1f}s"
    kinds = dict(zip(columns, [c[1] for c in cursor.description]))
    note += " types " + ",".join(
        f"{n}:{frame.schema[n].dataType.simpleString()}/{kinds[n]}" for n in names
        if frame.schema[n].dataType.simpleString() + str(kinds[n]) not in SAME
    )
    if ours == theirs:
        return True, note
    only_ours = list((ours - theirs).items())[:3]
    only_theirs = list((theirs - ours).items())[:3]
    return False, f"{note}\n  {names}\n  spark only: {only_ours}\n  duckdb only: {only_theirs}"


SAME = {
    "bigintBIGINT", "intINTEGER", "stringVARCHAR", "doubleDOUBLE", "booleanBOOLEAN",
    "timestampTIMESTAMP", "timestamp_ntzTIMESTAMP",
}


def main() -> None:
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name, run in queries.items():
        if wanted and name not in wanted:
            continue
        if name not in oracles:
            started = time.time()
            try:
                print(f"rows  {name}: {run(spark, sf_dir).count()} in {time.time() - started:.1f}s", flush=True)
            except Exception as error:  # noqa: BLE001
                bad.append(name)
                print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        try:
            same, note = compare(spark, con, run, oracles[name], sf_dir)
        except Exception as error:  # noqa: BLE001
            same, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        if not same:
            bad.append(name)
        print(f"{'ok   ' if same else 'WRONG'} {name}: {note}", flush=True)
    print("failing:", bad)


if __name__ == "__main__":
    main()

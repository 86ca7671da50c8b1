"""Run registered queries next to their SQL check: python tests/oracle_check.py [sf_dir] [names]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, float) and not math.isnan(value):
        return value + 0.0
    return value


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def odd_types(df, rel):
    """Columns whose types a strict reader could print differently on the two sides."""
    family = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
              "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    other = dict(zip(rel.columns, map(str, rel.types), strict=True))
    odd = [f"{c}:{t}/{other[c]}" for c, t in df.dtypes
           if family.get(t, other[c]) != other[c] and not (
               {t, other[c]} in ({"bigint", "INTEGER"}, {"int", "BIGINT"}))]
    return f" types {odd}" if odd else ""


def compare(spark, con, name, fn, sql, sf_dir):
    started = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    took = time.time() - started
    if sql is None:
        return True, f"rows={len(rows)} no SQL check", took, len(rows)
    columns = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != columns:
        return False, f"columns {columns} / {sorted(rel.columns)}", took, len(rows)
    picked = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql}) q")
    expected = sorted(repr(plain(r)) for r in picked.fetchall())
    actual = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows)
    if actual == expected:
        return True, f"rows={len(rows)}{odd_types(df, rel)}", took, len(rows)
    a, b = set(actual), set(expected)
    return False, (f"spark={len(actual)} sql={len(expected)}\n   spark only {sorted(a - b)[:2]}"
                   f"\n   sql only {sorted(b - a)[:2]}"), took, len(rows)


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for name, fn in queries.items():
        if wanted and not any(name == w or name.startswith(w.rstrip("*")) and w.endswith("*")
                              for w in wanted):
            continue
        try:
            ok, note, took, n = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report every query
            ok, note, took = False, f"{type(error).__name__}: {str(error)[:700]}", 0.0
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {took:6.2f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(queries)} queries, {len(sqls)} with SQL, bad: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

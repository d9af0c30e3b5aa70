"""Run registered queries beside their SQL in DuckDB and compare the results.

usage: python tests/compare.py [--sf 0.01] [--from NAME] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SAME = {
    "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def type_gaps(df, described):
    """Columns whose types are not each other's twin."""
    theirs = {row[0]: row[1] for row in described}
    gaps = [(n, t, theirs.get(n)) for n, t in df.dtypes if SAME.get(t) != theirs.get(n)]
    return f"  TYPES {gaps}" if gaps else ""


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got = normalised(df.columns, [tuple(x) for x in df.collect()])
    mid = time.time()
    if sql is None:
        return f"ROWS  {len(got[1])} rows  {mid - start:.1f}s", True
    kinds = type_gaps(df, con.execute(f"DESCRIBE {sql}").fetchall())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = normalised(names, cursor.fetchall())
    spent = f"{mid - start:.1f}s/{time.time() - mid:.1f}s"
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", False
    if len(got[1]) != len(want[1]):
        return f"COUNT {len(got[1])} != {len(want[1])} {spent}", False
    if got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        return f"VALUES {len(bad)} of {len(got[1])} differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}", False
    return f"ok {len(got[1])} rows {spent}{kinds}", True


def main(argv):
    import __spark_entry__ as entry
    from tidebar.session import build_session

    sf, names = "0.01", []
    it = iter(argv)
    start = None
    for a in it:
        if a == "--sf":
            sf = next(it)
        elif a == "--from":
            start = next(it)
        else:
            names.append(a)
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con, failed = duck(sf_dir), []
    queries, sqls = entry.queries(), entry.oracle_sql()
    order = list(queries)
    if start:
        names = order[order.index(start):]
    for name in names or order:
        try:
            text, good = compare(spark, con, name, queries[name], sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            text, good = f"ERROR {type(error).__name__} {str(error)[:900]}", False
        print(f"{name}: {text}", flush=True)
        if not good:
            failed.append(name)
    print("FAILED:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])

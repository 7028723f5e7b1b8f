"""Run registered queries next to their SQL twins.

    python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, float):
        return f"f:{v!r}"
    if isinstance(v, Decimal):
        return f"d:{v}"
    return f"s:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return None if got is not None else "no rows", len(got)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:2]
        only_b = [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}\n    spark: {only_a}\n    sql:   {only_b}", len(got)
    return None, len(got)


def main(argv):
    from vacantis import catalogue
    from vacantis.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    catalogue.load_all()
    spark = build_session("local[8]", 8, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in catalogue.QUERIES.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            diff, n = compare(spark, con, fn, catalogue.ORACLES.get(name), sf_dir)
        except Exception as e:  # report and go on
            diff, n = "ERROR " + str(e).strip()[:700], -1
        kind = "sql " if name in catalogue.ORACLES else "rows"
        print(f"{'ok  ' if diff is None else 'BAD '} {kind} {name:34s} {n:7d} rows {time.time() - t:6.2f}s", flush=True)
        if diff:
            bad += 1
            print("    " + diff, flush=True)
    print("failed:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

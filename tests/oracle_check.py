"""Compare registered queries with their oracle SQL: python tests/oracle_check.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimsift.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def kinds(columns, rows):
    """Value types per column, to notice a number on one side and a string on the other."""
    found = {c: set() for c in columns}
    for row in rows:
        for c, x in zip(columns, row):
            if x is not None:
                found[c].add(type(x).__name__)
    return found


def compare(spark, con, name, sf_dir, queries, oracles):
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in oracles:
        return len(got), None if got else "no rows"
    cursor = con.execute(oracles[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(columns)}"
    left, right = rows_of(df.columns, got), rows_of(columns, want)
    if kinds(df.columns, got) != kinds(columns, want):
        return len(got), f"types {kinds(df.columns, got)} vs {kinds(columns, want)}"
    if left != right:
        a = [x for x in left if x not in right][:2] if len(left) < 20000 else []
        b = [x for x in right if x not in left][:2] if len(right) < 20000 else []
        return len(got), f"{len(left)} vs {len(right)} rows\n   spark  {a}\n   oracle {b}"
    return len(got), None


def main(argv):
    from claimsift.plans import ORACLES, QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, bad = local_session(), oracle_connection(sf_dir), []
    for name in names:
        start = time.time()
        try:
            n, problem = compare(spark, con, name, sf_dir, QUERIES, ORACLES)
        except Exception as e:  # report and go on with the next query
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} {time.time() - start:.1f}s", flush=True)
        if problem:
            bad.append(name)
            print("   ", problem[:1500], flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} ok; oracles: {len(ORACLES)}; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Compare registered queries with their SQL: ``check_queries.py [prefix ...]``.

Run from the repository root; reads ``$CHECK_SF_DIR`` (default sf0.01).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from sightline.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def sortable(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def main(wanted: list[str]) -> int:
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    failed = 0
    oracles = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            begun = time.time()
            frame = run(spark, folder)
            columns = sorted(frame.columns)
            rows = [tuple(canonical(r[c]) for c in columns) for r in frame.collect()]
            took = time.time() - begun
            if name not in oracles:
                print(f"ROWS  {name}: {len(rows)} rows, {took:.1f}s", flush=True)
                continue
            begun = time.time()
            cursor = con.execute(oracles[name])
            names = [d[0] for d in cursor.description]
            place = [names.index(c) for c in columns] if sorted(names) == columns else None
            if place is None:
                raise AssertionError(f"columns {columns} against {sorted(names)}")
            expected = [tuple(canonical(r[i]) for i in place) for r in cursor.fetchall()]
            sql_took = time.time() - begun
            rows.sort(key=sortable)
            expected.sort(key=sortable)
            if rows == expected and rows:
                print(f"OK    {name}: {len(rows)} rows, {took:.1f}s (sql {sql_took:.1f}s)", flush=True)
            else:
                failed += 1
                print(f"DIFF  {name}: {len(rows)} against {len(expected)} rows; {columns}")
                odd = [(a, b) for a, b in zip(rows, expected) if a != b][:3]
                for mine, theirs in odd:
                    print("   spark", str(mine)[:300])
                    print("   sql  ", str(theirs)[:300])
                sys.stdout.flush()
        except Exception as error:  # keep checking the others
            failed += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

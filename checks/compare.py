"""Run registered queries in Spark and their SQL in DuckDB, and compare all rows.

    python -m checks.compare [--sf DIR] [NAME ...]
"""

from __future__ import annotations

import argparse
import time
import traceback

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def compare(spark, sf: str, name: str, build, statement: str | None, con) -> str:
    df = build(spark, sf)
    got = [tuple(r) for r in df.collect()]
    if statement is None:
        return f"rows only ({len(got)})"
    result = con.execute(statement)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} <> {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if a == b:
        return f"equal ({len(a)})"
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"DIFFERENT spark {len(a)} sql {len(b)}\n    spark: {only_a}\n    sql:   {only_b}"


def main() -> None:
    from alertloom.session import local_session
    from checks.catalogue import QUERIES, SQL

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = local_session("compare"), duck(args.sf)
    bad = 0
    for name, build in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            verdict = compare(spark, args.sf, name, build, SQL.get(name), con)
        except Exception as e:
            verdict = "ERROR " + "".join(traceback.format_exception_only(e))[:1500]
        bad += verdict.startswith(("ERROR", "DIFF", "COL"))
        print(f"{name:32s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{bad} failed")
    spark.stop()


if __name__ == "__main__":
    main()

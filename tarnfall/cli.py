"""Command line: ``convert`` a CSV file, ``run-query`` N on a converted table, or print the
schema of the workload's table."""

from __future__ import annotations

import argparse
import sys
import time

from tarnfall.plans.query import Query
from tarnfall.plans.hits_schema import HITS_SCHEMA
from tarnfall.plans.workload import Constants, workload
from tarnfall.session import build_session
from tarnfall.sources import sink, tables
from tarnfall.types import read_schema


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarnfall")
    parser.add_argument("--master", help="Spark master; by default spark-submit's")
    sub = parser.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="CSV with a schema file to Parquet")
    c.add_argument("schema")
    c.add_argument("data")
    c.add_argument("output")
    c.add_argument("--line-breaks", action="store_true", help="quoted fields may hold line breaks: a file is one task")
    c.add_argument("--split-lines", action="store_true", help="the default: large files are split at lines")
    sub.add_parser("hits-schema", help="print the schema of the workload's table, for convert")
    r = sub.add_parser("run-query", help="print a query's rows; the time goes to stderr")
    r.add_argument("number", type=int)
    r.add_argument("table")
    r.add_argument("--quoted", action="store_true", help="quote fields that need it")
    args = parser.parse_args(argv)
    if args.command == "hits-schema":
        sys.stdout.write(HITS_SCHEMA)
        return 0
    queries = workload(Constants())
    if args.command == "run-query" and args.number not in queries:
        print("Invalid query", file=sys.stderr)
        return 2
    spark = build_session(args.master)
    if args.command == "convert":
        tables.convert(spark, read_schema(args.schema), args.data, args.output, multi_line=args.line_breaks)
        return 0
    df = queries[args.number].build(Query.scan(spark, args.table)).df
    began = time.monotonic()
    sink.write_raw(sink.rows(df), sys.stdout, args.quoted)
    print(f"Time: {1000 * (time.monotonic() - began):.0f} ms", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

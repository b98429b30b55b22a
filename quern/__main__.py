"""``python -m quern list``, ``run QUERY TABLES OUT`` and ``explain QUERY TABLES``; ``--also MODULE`` adds a module's QUERIES."""

from __future__ import annotations

import argparse
import importlib

from quern.plans import catalog


def main() -> None:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    parser.add_argument("command", choices=("list", "run", "explain"))
    parser.add_argument("query", nargs="?")
    parser.add_argument("tables", nargs="?")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--also", action="append", default=[], metavar="MODULE")
    args = parser.parse_args()
    known = dict(catalog.QUERIES)
    for module in args.also:
        known |= importlib.import_module(module).QUERIES
    if args.command == "list":
        print("\n".join(sorted(known)))
        return
    if args.query not in known or not args.tables or (args.command == "run" and not args.out):
        parser.error("name a query of the list, the folder of the tables and, to run it, one for the result")
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = known[args.query](spark, args.tables)
    if args.command == "run":
        found.write.parquet(args.out)
    else:
        found.explain("formatted")


if __name__ == "__main__":
    main()

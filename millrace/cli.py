"""Command line: ``convert`` a CSV into Parquet, ``run`` queries over a ``hits`` table.

Queries are numbered from 1 (q01 is 1). Each result is written as CSV with a header, and
its seconds go to standard error.
"""

from __future__ import annotations

import argparse
import sys
import time

from millrace.plans import clickstream
from millrace.schema import load_schema
from millrace.session import get_session
from millrace.sources import csv_to_parquet, write_csv


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert")
    convert.add_argument("--input", required=True)
    convert.add_argument("--schema", required=True)
    convert.add_argument("--output", required=True)
    convert.add_argument("--lines", action="store_true", help="no field holds a line end: files are split")
    run = commands.add_parser("run")
    run.add_argument("--input", required=True, help="Parquet table")
    run.add_argument("--output_dir", required=True)
    run.add_argument("--queries", default="1-43", help="like 1,3,10-12")
    chosen = parser.parse_args(args)

    spark = get_session("millrace")
    if chosen.command == "convert":
        csv_to_parquet(spark, chosen.input, load_schema(chosen.schema), chosen.output, not chosen.lines)
        return 0
    table = spark.read.parquet(chosen.input)
    for part in chosen.queries.split(","):
        first, _, last = part.partition("-")
        for n in range(int(first), int(last or first) + 1):
            began = time.perf_counter()
            write_csv(clickstream.run(f"q{n:02d}", table), f"{chosen.output_dir}/q{n:02d}.csv", single_file=True)
            print(f"q{n:02d} {time.perf_counter() - began:.3f}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""``python -m tidewater.cli run NAME DIR [--out PATH]`` runs a registered query; ``list`` names them."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewater")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name")
    run.add_argument("dir")
    run.add_argument("--out")
    args = parser.parse_args(argv)
    from tidewater.plans import answers, context, evidence, events, integrity, prepare, reports, runs  # noqa: F401  they register queries
    from tidewater.plans.registry import QUERIES

    if args.command == "list":
        print("\n".join(QUERIES))
        return 0
    from pyspark.sql import SparkSession

    df = QUERIES[args.name](SparkSession.builder.appName("tidewater").getOrCreate(), args.dir)
    df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line: list the query catalogue, run one query, show or write its result.

    python -m cirrus list
    python -m cirrus run quota_usage --data /path/to/tables [--out /path/out --format parquet] [--show 20]
    python -m cirrus explain quota_usage --data /path/to/tables

On a cluster this is the body of a spark-submit job: the session picks up the
cluster's master and configuration, ``--profile cluster`` adds the library's
large-scale settings, and ``--out`` should name shared storage.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="cirrus")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="query keys with their SURVEY section and oracle availability")
    for name in ("run", "explain"):
        p = sub.add_parser(name)
        p.add_argument("key")
        p.add_argument("--data", required=True, help="folder holding the <table>.parquet inputs")
        p.add_argument("--master", default=None)
        p.add_argument("--profile", default="local", choices=["local", "cluster"])
        if name == "run":
            p.add_argument("--out", default=None, help="write the result here instead of showing it")
            p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
            p.add_argument("--show", type=int, default=20)
    args = ap.parse_args(argv)

    from cirrus.plans import registry
    registry.load_all()
    if args.cmd == "list":
        for k in registry.QUERIES:
            oracle = "sql" if k in registry.ORACLE_SQL else "rows"
            print(f"{registry.SECTIONS[k]:>5}  {oracle:4}  {k}")
        return 0

    if args.key not in registry.QUERIES:
        print(f"unknown query {args.key!r}; see `python -m cirrus list`", file=sys.stderr)
        return 2
    from cirrus.session import get_session
    spark = get_session(args.master, profile=args.profile)
    df = registry.QUERIES[args.key](spark, args.data)
    if args.cmd == "explain":
        df.explain("formatted")
    elif args.out:
        writer = df.write.mode("overwrite")
        if args.format == "csv":
            writer = writer.option("header", "true")
        writer.format(args.format).save(args.out)
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

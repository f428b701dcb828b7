"""Command line: list the queries, run one over a folder of tables, or export its rows."""

from __future__ import annotations

import argparse

from .plans import catalog
from .session import session
from .sources import tables


def main() -> None:
    parser = argparse.ArgumentParser(prog="quern", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    for name in ("run", "explain", "export"):
        p = commands.add_parser(name)
        p.add_argument("query")
        p.add_argument("folder")
        if name == "export":
            p.add_argument("path")
            p.add_argument("--format", choices=("csv", "json", "parquet"), default="parquet")
    args = parser.parse_args()
    found = catalog.queries()
    if args.command == "list":
        print("\n".join(sorted(found)))
        return
    df = found[args.query](session(), args.folder)
    if args.command == "run":
        df.show(50, truncate=100)
    elif args.command == "explain":
        df.explain("formatted")
    elif args.format == "csv":
        tables.export_csv(df, args.path)
    elif args.format == "json":
        tables.export_json(df, args.path)
    else:
        df.write.parquet(args.path)


if __name__ == "__main__":
    main()

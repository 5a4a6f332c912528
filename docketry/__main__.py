"""Command line: ``python -m docketry <command>``. Exit codes: 0 done, 1 gate not met, 2 something needed is missing."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from .session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docketry")
    p.add_argument("--runs", help="run log (JSON lines)")
    sub = p.add_subparsers(dest="command", required=True)
    for name, extra in {
        "query": ["name", "sf_dir"],
        "preprocess": ["root", "corpus", "report"],
        "ingest-texts": ["root", "archive", "corpus", "report"],
        "ingest-zips": ["root", "archive", "corpus", "report"],
        "spend": ["ledger"],
        "status": ["root", "corpus"],
    }.items():
        c = sub.add_parser(name)
        for a in extra:
            c.add_argument(a)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session()
    code = _run(spark, args)
    if args.runs:  # after the command has returned: an exception leaves no record
        from .sources.tables import append_run

        append_run(args.runs, {"ts": datetime.now(UTC).isoformat(), "command": args.command, "argv": argv or sys.argv[1:], "exit_code": code})
    return code


def _run(spark, args) -> int:
    from . import schemas
    from .operators import spend
    from .plans import catalogue, ingest, preprocess
    from .sources import tables

    if args.command == "query":
        if args.name not in catalogue.QUERIES:
            print(f"no query {args.name}", file=sys.stderr)
            return 2
        catalogue.QUERIES[args.name](spark, args.sf_dir).show(50, truncate=False)
        return 0
    if args.command == "preprocess":
        return preprocess.run(spark, args.root, args.corpus, args.report)
    if args.command == "ingest-texts":
        return ingest.tab_texts(spark, args.root, args.archive, args.corpus, args.report)
    if args.command == "ingest-zips":
        return ingest.load_zips(spark, args.root, args.archive, args.corpus, args.report)
    if args.command == "spend":
        spend.totals(tables.read_log(spark, args.ledger, schemas.SPEND)).show()
        return 0
    counts = {}
    for table in schemas.REGISTRY:
        path = tables.table_path(args.root, args.corpus, table)
        counts[table] = tables.row_count(spark, path) if tables._exists(spark, path) else None
    print(json.dumps(counts, indent=2, sort_keys=True))
    return 0


if __name__ == "__main__":
    sys.exit(main())

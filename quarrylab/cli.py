"""Command line: `python -m quarrylab.cli inspect STORE` and `check-health STORE...`."""

from __future__ import annotations

import argparse
import json
import sys

from .plans.health import batch_health_check
from .plans.store import Store
from .session import build_spark, ship


def _text(report: list[dict]) -> str:
    lines = []
    for table in report:
        lines.append(f"{table['table_name']}: {table['row_count']} rows")
        lines += [f"  {c['name']} {c['type']}" + " primary key" * c["pk"] + " not null" * c["notnull"] for c in table["columns"]]
        lines += [f"    {row}" for row in table["sample_data"]]
    return "\n".join(lines)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarrylab")
    commands = parser.add_subparsers(dest="command", required=True)
    inspect = commands.add_parser("inspect", help="columns, row counts and samples of a store's tables")
    inspect.add_argument("store")
    inspect.add_argument("--tables", nargs="*")
    inspect.add_argument("--samples", type=int, default=5)
    inspect.add_argument("--skip-count", action="store_true")
    health = commands.add_parser("check-health", help="health of stores; status 1 if one is not healthy")
    health.add_argument("stores", nargs="+")
    health.add_argument("--fix", action="store_true", help="compact the tables and drop files out of use")
    health.add_argument("--dry-run", action="store_true", help="say what --fix would do, and do nothing")
    health.add_argument("--yes", "-y", action="store_true")
    health.add_argument("--quiet", "-q", action="store_true", help="name the stores alone that are not healthy")
    for command in (inspect, health):
        command.add_argument("--json", action="store_true")
        command.add_argument("--master", default="local[*]")
    given = parser.parse_args(arguments)
    if given.command == "check-health" and given.fix and not given.yes and not given.dry_run:
        print("--fix rewrites tables and needs --yes", file=sys.stderr)
        return 2
    spark = build_spark(given.master)
    ship(spark)
    if given.command == "inspect":
        with Store(spark, given.store, mode="ro") as store:
            report = store.inspect(given.tables, given.samples, given.skip_count)
        print(json.dumps(report, default=str) if given.json else _text(report))
        return 0
    found = batch_health_check(spark, given.stores, given.fix and not given.dry_run)
    for name, report in [] if given.json else found["reports"].items():
        if given.quiet and report["status"] == "HEALTHY":
            continue
        advice = [] if given.quiet else report.get("recommendations", [])
        print(f"{name}: {report['status']} ({report['health_score']})", *report["issues"], *[f"{'would mend' if given.dry_run else 'advice'}: {a}" for a in advice], sep="\n  ")
    if given.json:
        print(json.dumps(found, default=str))
    return int(any(r["status"] != "HEALTHY" for r in found["reports"].values()))


if __name__ == "__main__":
    sys.exit(main())

"""Command line: ``python -m skein COMMAND``. Every result is one JSON record per line."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.records import envelope
from skein.operators.sessions import relative_time


def _emit(schema: str, rows: DataFrame) -> int:
    """Print rows one by one; how many there were."""
    n = 0
    for row in rows.select(F.to_json(F.struct("*"))).toLocalIterator():
        print(json.dumps({"schema": schema, "record": json.loads(row[0])}, ensure_ascii=False))
        n += 1
    return n


def _emit_one(schema: str, record: dict) -> None:
    print(json.dumps({"schema": schema, "record": record}, ensure_ascii=False))


#: Commands that read the homes alone.
READ = ("list", "show", "sources", "dump", "current")
CLAIMS = "harness string, pid long, started_at string, native_id string, certainty string, exact_session string, evidence array<string>, reason string"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="skein")
    parser.add_argument("--codex", help="home of rollout logs")
    parser.add_argument("--claude", help="directory of project transcripts")
    parser.add_argument("--catalog", help="root of the catalog")
    commands = parser.add_subparsers(dest="command", required=True)
    command = commands.add_parser("list", help="sessions, most recent first")
    command.add_argument("--since")
    command.add_argument("--until")
    command = commands.add_parser("show", help="events of a session, by its id or the start of it")
    command.add_argument("session")
    commands.add_parser("scan", help="bring the catalog up to date")
    command = commands.add_parser("search", help="passages; exit status 1 if there is none")
    command.add_argument("query")
    command.add_argument("--mode", choices=("lexical", "literal"), default="lexical")
    command.add_argument("--limit", type=int, default=20)
    command.add_argument("--harness", choices=("codex", "claude"))
    command.add_argument("--stale", action="store_true", help="do not scan first if the catalog is behind")
    commands.add_parser("status", help="what the published generation holds, and how far it is behind")
    commands.add_parser("reclaim", help="drop what no generation presents any more")
    for name in ("export", "import"):
        commands.add_parser(name, help=f"{name} the retained state").add_argument("file")
    commands.add_parser("sources", help="what the homes hold, whether it is read or not")
    command = commands.add_parser("dump", help="one JSON document of a session's events")
    command.add_argument("session")
    command = commands.add_parser("current", help="sessions that running processes work on")
    command.add_argument("claims", help="a JSON file of process claims, one a line")
    command.add_argument("--exact", action="store_true", help="only what a process proves")
    commands.add_parser("doctor", help="check the catalog; exit status 1 if something is broken")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    homes = {h: d for h, d in (("codex", args.codex), ("claude", args.claude)) if d}
    if args.command in READ + ("scan", "status") and not homes:
        raise SystemExit("give --codex or --claude")
    if args.command not in READ and not args.catalog:
        raise SystemExit("give --catalog")
    spark = spark or SparkSession.builder.appName("skein").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from skein.plans import listing
    from skein.plans.store import Catalog

    store = Catalog(spark, args.catalog) if args.catalog else None
    if args.command == "list":
        now = datetime.now(UTC)
        since, until = (F.lit(relative_time(x, now)) if x else None for x in (args.since, args.until))
        _emit("skein.session/v1", listing.listed(spark, homes, since, until))
    elif args.command == "show":
        _emit("skein.event/v1", listing.read(spark, homes, args.session))
    elif args.command == "sources":
        _emit("skein.source/v1", listing.sources(spark, homes).drop("rank"))
    elif args.command == "dump":
        events = listing.read(spark, homes, args.session).drop("payload", "content")
        print(envelope(events, "skein.session/v1", "skein", ["record", "event_index"]).first().document)
    elif args.command == "current":
        _emit("skein.presence/v1", listing.current(spark, homes, spark.read.schema(CLAIMS).json(args.claims), args.exact))
    elif args.command == "doctor":
        report = store.doctor()
        for row in report:
            _emit_one("skein.check/v1", row)
        return int(any(r["status"] == "error" for r in report))
    elif args.command == "scan":
        _emit_one("skein.scan/v1", {**store.scan(homes), "generation": store.generation(), "changes": store.changes()})
    elif args.command == "search":
        if homes and not args.stale and any(store.behind(homes).values()):
            store.scan(homes)
        return 0 if _emit("skein.hit/v1", store.search(args.query, args.mode, args.limit, args.harness)) else 1
    elif args.command == "status":
        _emit_one("skein.status/v1", {"generation": store.generation(), **store.counts(), "behind": store.behind(homes)})
    elif args.command == "reclaim":
        _emit_one("skein.reclaim/v1", {"generations": store.reclaim()})
    elif args.command == "export":
        _emit_one("skein.export/v1", store.export(args.file))
    else:
        store.import_state(args.file)
    return 0


if __name__ == "__main__":
    sys.exit(main())

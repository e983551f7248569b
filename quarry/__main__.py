"""The command line: ``python -m quarry <command>``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _spark(master: str | None) -> SparkSession:
    from quarry.session import local_session

    return local_session() if master is None else SparkSession.builder.master(master).appName("quarry").getOrCreate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description="Boolean search over indexed records")
    top.add_argument("--master", help="Spark master; without it a local session runs")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *positional: str) -> argparse.ArgumentParser:
        found = commands.add_parser(name, help=about)
        for p in positional:
            found.add_argument(p)
        return found

    command("parse", "read a query: its canonical form, errors and warnings", "query").add_argument("--mode", default="native")
    command("snapshot", "write a snapshot of records (JSON lines)", "records", "path")
    command("verify", "read a snapshot and check it against its manifest", "path")
    command("index", "build an index of a snapshot", "snapshot", "path").add_argument("--postings", action="store_true")
    search = command("search", "search an index", "index", "query")
    for name, kind, default in (("--mode", str, "native"), ("--sort", str, "relevance"), ("--offset", int, 0), ("--limit", int, 50)):
        search.add_argument(name, type=kind, default=default)
    search.add_argument("--facets", action="store_true")
    search.add_argument("--groups", action="store_true")
    export = command("export", "write all matches under a folder", "index", "query", "path")
    export.add_argument("--format", default="ris")
    export.add_argument("--mode", default="native")
    command("explain", "the tree, its expansions and Spark's plan", "index", "query").add_argument("--mode", default="native")
    command("parity", "terms whose stored counts differ from a recount", "index")
    command("coverage", "counts by venue, year, track and status", "index")
    command("serve", "answer on HTTP", "index").add_argument("--port", type=int, default=8080)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "parse":
        from quarry.plans.parse import parse

        found = parse(args.query, args.mode)
        print(json.dumps({"canonical": found.canonical, "hash": found.canonical_hash, "errors": [[d.code, d.message, d.span] for d in found.errors], "warnings": [[d.code, d.message, d.span] for d in found.warnings], "translations": [[d.code, d.message, d.span] for d in found.translations]}, indent=1))
        return 0 if found.ok else 1

    from quarry.operators.search import Index
    from quarry.service import Service, serve
    from quarry.sources import export, snapshots

    spark = _spark(args.master)
    if args.command == "snapshot":
        made = snapshots.write(spark.read.json(args.records), args.path)
        print(json.dumps({k: made[k] for k in ("record_count", "cuts", "corpus_hash")}))
        return 0
    if args.command == "verify":
        print(snapshots.read(spark, args.path).count())
        return 0
    if args.command == "index":
        stated = snapshots.manifest(spark, args.snapshot)
        print(Index.build(snapshots.read(spark, args.snapshot), None, stated["corpus_hash"], args.path, args.postings).version)
        return 0
    index = Index.open(spark, args.index)
    service = Service(index)
    if args.command == "search":
        print(json.dumps(service.search(args.query, args.mode, args.sort, args.offset, args.limit, args.facets, args.groups), default=str, indent=1))
    elif args.command == "export":
        found = index.match(args.query, args.mode)
        print(export.write(found, args.format, args.path, expected=found.count()))
    elif args.command == "explain":
        print(index.explain(args.query, args.mode))
    elif args.command == "parity":
        wrong = index.parity()
        wrong.show(50, truncate=False)
        return int(not wrong.isEmpty())
    elif args.command == "coverage":
        print(json.dumps(service.coverage(), default=str))
    elif args.command == "serve":
        serve(service, args.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())

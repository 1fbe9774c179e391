"""Commands over a store: ``python -m tessera.cli --store PATH COMMAND ...``; results as a table, JSON lines or simple lines."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import Engine
from .operators import reports
from .session import session

SHOWN = ("chunk_id", "file_path", "function_name", "class_name", "layer_type", "start_line", "end_line", "score")


def parser() -> argparse.ArgumentParser:
    """The commands and their options."""
    out = argparse.ArgumentParser(prog="tessera", description=__doc__)
    out.add_argument("--store", required=True, help="folder of the store")
    out.add_argument("--format", choices=("table", "json", "simple"), default="table")
    out.add_argument("--limit", type=int, default=10)
    commands = out.add_subparsers(dest="command", required=True)
    for name, words in (("process", "read, mask, embed and store a repository"), ("update", "bring the store up to date with the files"), ("commits", "bring the store up to date commit by commit")):
        c = commands.add_parser(name, help=words)
        c.add_argument("repository")
        c.add_argument("--project", default="default")
    search = commands.add_parser("search", help="search by text")
    search.add_argument("query")
    search.add_argument("--mode", choices=("hybrid", "semantic", "keyword"), default="hybrid")
    search.add_argument("--project")
    find = commands.add_parser("find", help="chunks with given values")
    for name in ("language", "layer-type", "function-name", "class-name"):
        find.add_argument(f"--{name}")
    find.add_argument("--glob", action="append", default=[], help="a pattern that the path must fit")
    find.add_argument("--offset", type=int, default=0)
    for name, words in (("status", "chunks, files and contents of each project"), ("projects", "numbers of each project"), ("secrets", "report on secrets"), ("memo", "use of the embedding memo")):
        commands.add_parser(name, help=words)
    return out


def result(engine: Engine, options: argparse.Namespace) -> DataFrame:
    """What a command shows."""
    command = options.command
    if command == "process":
        return engine.process_repository(options.repository, options.project)
    if command == "update":
        return engine.spark.createDataFrame(sorted(engine.process_update(options.repository, options.project).items()), "change string, n long")
    if command == "commits":
        return engine.process_commits(options.repository, options.project)
    if command == "search":
        found = engine.hybrid_search(options.query, options.limit, options.mode, project=options.project)
        return found.select(*[c for c in SHOWN if c in found.columns])
    if command == "find":
        names = ("language", "layer_type", "function_name", "class_name")
        wanted = {c: v for c in names if (v := getattr(options, c)) is not None}
        rows = reports.metadata_page(engine.chunks.read(), wanted, tuple(options.glob), offset=options.offset, limit=options.limit)
        return rows.select(*[c for c in SHOWN if c in rows.columns])
    if command == "projects":
        found = reports.project_report(engine.chunks.read())
        return found.withColumns({c: reports.spelled(c) for c in ("language", "layer_type")})
    if command == "secrets":
        found = reports.secret_report(engine.chunks.read(), most=options.limit)
        return found.select(F.col("high_risk").cast("string").alias("high_risk"), *[reports.spelled(c).alias(c) for c in ("sensitivity_level", "secret_type", "pattern_name")])
    return engine.memo.stats() if command == "memo" else engine.status()


def main(arguments: Sequence[str] | None = None, spark=None, out=sys.stdout) -> int:
    """Run a command; 0, or 1 if it failed."""
    options = parser().parse_args(arguments)
    try:
        rows = result(Engine(spark or session(name="tessera"), options.store), options)
        for r in reports.rendered(rows, options.format).limit(max(options.limit, 1)).collect():
            print(r["line"], file=out)
    except Exception as error:  # noqa: BLE001
        print(f"failed: {str(error)[:500]}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

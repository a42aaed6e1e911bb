"""Command line: python -m loomlog LOG COMMAND [ARGUMENTS]."""

from __future__ import annotations

import argparse
import json
import sys

from loomlog import errors
from loomlog.schema import DURABILITIES, STRICT


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomlog", description=__doc__)
    p.add_argument("log", help="the log's folder")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arguments in {
        "put": ("key", "value"), "get": ("key",), "delete": ("key",), "exists": ("key",), "stats": (), "frontier": (), "inspect": (), "compact": (),
        "sync": (), "checkpoint": ("path",), "snapshot": ("path",), "restore": ("path",), "snapshot-inspect": ("path",), "version": (),
    }.items():
        s = sub.add_parser(name)
        for a in arguments:
            s.add_argument(a)
        if name in ("put", "delete"):
            s.add_argument("--durability", choices=DURABILITIES, default="strict")
        if name in ("checkpoint", "snapshot"):
            s.add_argument("--kind", choices=("visible", "durable"), default="durable")
    return p


def run(log, args: argparse.Namespace) -> object:
    c = args.command
    if c in ("put", "delete"):
        durability = DURABILITIES.get(args.durability, STRICT)
        log.put(args.key, args.value, durability) if c == "put" else log.delete(args.key, durability)
        return log.commit()
    if c == "get":
        return log.get(args.key).decode(errors="replace")
    if c == "exists":
        return log.exists(args.key)
    if c == "checkpoint":
        return log.save_checkpoint(args.path, args.kind)
    if c == "snapshot":
        return log.snapshot(args.path, args.kind)
    if c == "restore":
        return log.restore(args.path)
    if c == "snapshot-inspect":
        return log.inspect_snapshot(args.path)
    return {"stats": log.stats, "frontier": log.frontier, "inspect": log.inspect, "compact": log.compact, "sync": log.sync, "version": log.version}[c]()


def main(argv: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import SparkSession

    from loomlog.api import Log

    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loomlog").getOrCreate()
    try:
        print(json.dumps(run(Log(spark, args.log), args)))
    except errors.LogError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0

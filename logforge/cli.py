"""Command line: ``python -m logforge.cli segment cat FILE...`` and so on."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans import commands


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logforge", description="Analyses of log-segment and producer-snapshot dumps.")
    sub = p.add_subparsers(dest="command", required=True)
    options = {
        "line_numbers": (("--line-numbers", "-l"), {"action": "store_true", "help": "print line numbers of the dump"}),
        "pid": (("--pid",), {"type": int, "help": "only this producer id"}),
        "producer_epoch": (("--producer-epoch",), {"type": int, "help": "only this producer epoch"}),
        "leader_epoch": (("--leader-epoch",), {"type": int, "help": "only this leader epoch"}),
        "transactional_id": (("--transactional-id",), {"help": "only this transactional id"}),
    }
    for group, actions in {
        "segment": {"cat": ("line_numbers", "pid", "producer_epoch", "leader_epoch", "transactional_id"), "txn-stat": ("line_numbers", "pid", "producer_epoch", "leader_epoch")},
        "snapshot": {"cat": ("line_numbers", "pid", "producer_epoch"), "abort-cmd": ("pid", "producer_epoch")},
    }.items():
        inner = sub.add_parser(group).add_subparsers(dest="action", required=True)
        for action, names in actions.items():
            a = inner.add_parser(action)
            for n in names:
                flags, settings = options[n]
                a.add_argument(*flags, **settings, **({"required": True} if action == "abort-cmd" else {}))
            if action != "txn-stat" and action != "abort-cmd":
                a.add_argument("--colour", action="store_true")
            a.add_argument("files", nargs="+")
    for name in ("txn-coordinating-partition", "group-coordinating-partition"):
        a = sub.add_parser(name)
        a.add_argument("id")
        a.add_argument("num_partitions", nargs="?", type=int, default=50)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    options = vars(parser().parse_args(args))
    spark = spark or SparkSession.builder.appName("logforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    command, action = options.pop("command"), options.pop("action", None)
    if action is None:
        print(commands.partition_of(spark, options["id"], options["num_partitions"]))
        return 0
    files = options.pop("files")
    if command == "segment":
        for row in commands.unknown_paths(spark, files).toLocalIterator():
            print(f"{row['file_name']}: {row['message']}", file=sys.stderr)
    try:
        lines = commands.run(spark, (command, action), files, **options)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    for row in lines.select("line_out").toLocalIterator():
        print(row[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""``python -m plumbline run CONFIG | merge PATH N SCHEMA | summarize FOLDER [METRIC BY...] | list``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from plumbline.operators import accounting, events, statistics
from plumbline.plans import execution, experiment
from plumbline.sources import jsonl


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="plumbline")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run an experiment from its configuration")
    run.add_argument("config")
    look = commands.add_parser("summarize", help="what the event log of a run says")
    look.add_argument("folder")
    look.add_argument("metric", nargs="?", help="also the summary of this column")
    look.add_argument("by", nargs="*", help="per these columns")
    merge = commands.add_parser("merge", help="write the shards of a sink of JSON lines as one")
    merge.add_argument("path")
    merge.add_argument("n", type=int)
    merge.add_argument("schema", help="columns of the rows, such as 'unit_id string, seq bigint, error string'")
    commands.add_parser("list", help="names that a configuration may use")
    args = parser.parse_args(argv)
    if args.command == "list":
        for kind, names in sorted(experiment.REGISTRY.items()):
            print(f"{kind}: {', '.join(sorted(names))}")
        return
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    if args.command == "run":
        out = experiment.from_config(spark, args.config).run()
        for name, table in out.get("tables", {}).items():
            print(name)
            table.show(50, False)
        if "halted" in out:
            print(out["halted"])
        return
    if args.command == "merge":
        print(jsonl.combine_shards(spark, args.path, args.n, args.schema))
        return
    if args.metric:
        rows = execution.Run(args.folder).table(spark, "rows")
        if rows is None:
            raise SystemExit(f"{args.folder} has no rows")
        statistics.summarize(accounting.latest_rows(rows), args.metric, args.by).show(1000, False)
    log = execution.Run(args.folder).table(spark, "events")
    if log is None:
        raise SystemExit(f"{args.folder} has no event log")
    print(events.format_summary(events.summarize_events(log)))


if __name__ == "__main__":
    main()

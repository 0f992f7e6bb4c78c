"""Commands for spark-submit: ``python -m spanlake <command> --help``."""

from __future__ import annotations

import argparse

from . import sources
from .operators import access_log, spans, store
from .plans import exports
from .session import build_session


def _print_all(df):
    """Every row as a line of JSON. The driver holds one partition at a time."""
    for row in df.toJSON().toLocalIterator():
        print(row)


def _stats(spark, args):
    _print_all(store.file_stats(spark, args.path).orderBy("path"))
    store.dataset_stats(spark, args.path).show()


def _inspect(spark, args):
    df = spark.read.parquet(args.path)
    store.shape(df).show(truncate=False)
    store.preview(df, args.limit).show(args.limit, truncate=False)
    if {"prompt_tokens", "completion_tokens", "total_tokens"} <= set(df.columns):
        spans.token_totals(df).show()


def _calls(spark, args):
    table = sources.latest_shard(spark, args.path)
    chosen = spans.earliest(table, args.limit) if args.early else spans.latest(table, args.limit)
    spans.call_view(chosen).show(args.limit, truncate=False, vertical=True)


def _logs(spark, args):
    log, broken = sources.split_log(sources.read_access_log(spark, args.path))
    if args.type is not None or args.status is not None:
        _print_all(access_log.filter_log(log, args.type, args.status))
        return
    access_log.log_summary(log).show(truncate=False, vertical=True)
    for name in ("type", "status", "path", "error_path"):
        key = {"type": "type", "status": "status_code"}.get(name, "path")
        counted = getattr(access_log, f"count_by_{name}")(log)
        access_log.most_common(counted, key).show(truncate=False)
    if args.details:
        access_log.log_detail_view(log).show(args.limit, truncate=False, vertical=True)
    _print_all(broken)


def _export(spark, args):
    exports.export(spark, args.path, args.target, args.format, args.type, args.sft_format, args.thoughts, args.split)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spanlake", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(name, run, about):
        sub = commands.add_parser(name, help=about)
        sub.add_argument("path")
        sub.add_argument("--limit", type=int, default=10)
        sub.set_defaults(run=run)
        return sub

    command("stats", _stats, "rows and bytes per file")
    command("inspect", _inspect, "shape, first rows and token totals of a Parquet folder")
    calls = command("calls", _calls, "calls of the newest shard")
    calls.add_argument("--early", action="store_true")
    logs = command("logs", _logs, "summary of an access log, or filtered entries")
    logs.add_argument("--details", action="store_true")
    logs.add_argument("--type", choices=["request", "response", "error"])
    logs.add_argument("--status", type=int)
    export = command("export", _export, "records to a training set")
    export.add_argument("target")
    export.add_argument("--format", choices=["trl", "hf"], default="trl")
    export.add_argument("--type", choices=["sft", "rl"], default="sft")
    export.add_argument("--sft-format", choices=list(exports.SFT_FORMATS), default="conversational")
    export.add_argument("--thoughts", action="store_true")
    export.add_argument("--split", action="store_true")
    args = parser.parse_args(argv)
    args.run(build_session(), args)


if __name__ == "__main__":
    main()

"""Command line: run, backfill and doctor."""

from __future__ import annotations

import argparse
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession

from sealane.plans import program, publish
from sealane.plans.config import Settings
from sealane.sources import readers


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sealane", description="Vessel tracks around submarine cables")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="collect what has landed, detect and publish")
    run.add_argument("--window-days", type=int)
    fill = commands.add_parser("backfill", help="archive zipped daily files, then run over their days")
    fill.add_argument("--files", required=True, help="folder of daily archives")
    fill.add_argument("--date", required=True, help="last day, YYYY-MM-DD")
    fill.add_argument("--days", type=int, default=1)
    commands.add_parser("doctor", help="say what a run would find")
    for command in commands.choices.values():
        command.add_argument("--config", required=True)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("sealane").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = Settings.load(args.config)
    if args.command == "doctor":
        found = program.doctor(spark, settings)
        for what, well, remark in found:
            print("ok  " if well else "MISS", what, remark)
        return 0 if all(well for _, well, _ in found) else 1
    now, days = None, getattr(args, "window_days", None)
    if args.command == "backfill":
        end = datetime.strptime(args.date, "%Y-%m-%d").replace(tzinfo=timezone.utc) + timedelta(days=1)
        start, now, days = end - timedelta(days=args.days), end, args.days
        rows = readers.zipped_daily_rows(spark, args.files, settings.bbox)
        publish.archive(readers.daily_positions(rows, start, end), f"{settings.data_dir}/positions")
        program.archive_static(readers.daily_static(rows), f"{settings.data_dir}/static", end.strftime("%Y%m%dT%H%M%S"))
    out = program.run(spark, settings, now, days)
    for warning in out.warnings:
        print("warning:", warning)
    print(out.counts, "changed" if out.changed else "unchanged")
    return out.code


if __name__ == "__main__":
    raise SystemExit(main())

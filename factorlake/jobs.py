"""The three jobs for ``spark-submit``: bars, factors and ic.

    spark-submit factorlake/jobs.py --lake s3a://bucket/lake bars --landing s3a://bucket/landing
    spark-submit factorlake/jobs.py --lake s3a://bucket/lake factors --names rsi14 ma_cross
    spark-submit factorlake/jobs.py --lake s3a://bucket/lake ic --start 2023-01-01 --end 2023-12-31

A failing job leaves an error status (bars, factors) and a non-zero exit code.
"""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import functions as F

from factorlake.functions.scalars import parse_day
from factorlake.plans.factors import DEFAULT_NAMES
from factorlake.plans.incremental import LOOKBACK_DAYS, update_bars, update_factors
from factorlake.plans.research import LAGS, ic_run
from factorlake.session import build_session
from factorlake.sources.lake import Lake
from factorlake.sources.landing import scan_landing, with_ingest


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="factorlake.jobs")
    top.add_argument("--lake", required=True, help="root folder of the tables")
    jobs = top.add_subparsers(dest="job", required=True)
    day = date.fromisoformat
    for name in ("bars", "factors"):
        job = jobs.add_parser(name)
        job.add_argument("--as-of", type=day, default=date.today())
        job.add_argument("--lookback-days", type=int, default=LOOKBACK_DAYS)
        job.add_argument("--force", action="store_true", help="also days that are complete")
    jobs.choices["bars"].add_argument("--landing", required=True)
    jobs.choices["bars"].add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    jobs.choices["factors"].add_argument("--names", nargs="*", default=None)
    job = jobs.add_parser("ic")
    job.add_argument("--start", type=day, required=True)
    job.add_argument("--end", type=day, required=True)
    job.add_argument("--names", nargs="*", default=DEFAULT_NAMES)
    job.add_argument("--lags", nargs="*", type=int, default=list(LAGS))
    job.add_argument("--report", default=None, help="folder of the CSV summary")
    return top


def run(spark, arguments: list[str] | None = None) -> int:
    """Runs one job; the number of rows it stored, or of its summary."""
    args = parser().parse_args(arguments)
    lake = Lake(spark, args.lake)
    if args.job == "bars":
        landed = scan_landing(spark, args.landing, args.format)
        if args.format == "parquet":  # row numbers inside a file exist for Parquet only
            landed = with_ingest(landed)
        # The days that landed are the days to fill.
        calendar = landed.select(parse_day("trade_date").alias("time")).distinct()
        return update_bars(lake, landed, calendar, args.as_of, args.lookback_days, args.force)
    if args.job == "factors":
        return update_factors(lake, args.as_of, args.lookback_days, args.force, args.names)
    found = ic_run(lake, args.start, args.end, list(args.names), tuple(args.lags), args.report)
    rows = found.summary.orderBy("lag", F.desc_nulls_first("ic_ir")).collect()
    for row in rows:
        print(row)
    return len(rows)


if __name__ == "__main__":
    run(build_session("factorlake"))

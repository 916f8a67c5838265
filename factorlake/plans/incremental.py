"""Incremental runs: find missing days, load or compute them, upsert, record the status."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from factorlake.functions.scalars import VENDOR_DAY
from factorlake.operators.columns import in_range
from factorlake.operators.joins import keep_dates, missing_dates
from factorlake.plans.carry import carried_factors, long_factors
from factorlake.plans.factors import PandasFactor, compute_factors
from factorlake.sources.lake import Lake
from factorlake.sources.landing import ingest_order, normalize_bars, unreadable
from factorlake.sources.status import PartialRun, record_sync, reported

# Fixed value: days re-checked by a run.
LOOKBACK_DAYS = 7
# Errors kept in the status text of a factor run.
FACTOR_ERRORS = 5
NO_DAY = "unreadable day"


def _last_day(days: DataFrame) -> date | None:
    return days.agg(F.max("time").cast("date").alias("d")).first()["d"]


def factor_gaps(bars: DataFrame, gaps: DataFrame, names: list[str] | None = None,
                warmup_days: int | None = None, bound: int | None = None) -> DataFrame:
    """Factor rows of the days in ``gaps`` (one ``time`` column).

    By default the whole history of each symbol feeds its averages, so values do not depend
    on when the run happened. ``warmup_days`` starts that many calendar days before the
    first gap instead.
    """
    if warmup_days is not None:
        first = gaps.agg(F.min("time").alias("first")).scalar()
        bars = bars.filter(F.col("time") >= first - F.make_dt_interval(F.lit(warmup_days)))
    return keep_dates(compute_factors(bars, names, bound), gaps)


def update_factors(lake: Lake, as_of: date, lookback_days: int = LOOKBACK_DAYS, force: bool = False,
                   names: list[str] | None = None, warmup_days: int | None = None,
                   grain: list[str] | None = None, plugins: list[PandasFactor] | None = None) -> int:
    """Compute and store the factors of recent market days that have none; returns the row count.

    Values are those of the whole history of each symbol, so they do not depend on when the run
    happened: the run goes on from the state of each symbol at the end of the month before the first gap
    (see ``carry``) and reads no older bars. ``warmup_days`` starts afresh that many calendar days before the
    first gap instead.
    ``grain=["time", "symbol"]`` looks for gaps per symbol as well. ``plugins`` are computed for the same gaps, from
    all history or from ``warmup_days`` before the first gap. Where a plug-in fails for a symbol, the
    values of that symbol are left out and all else is stored; then the status names the first of these symbols, and
    ``PartialRun`` is raised. A run that fails otherwise leaves an error status and raises.
    """
    with reported(lake, "factors"):
        return _update_factors(lake, as_of, lookback_days, force, names, warmup_days, grain, plugins or [])


def _update_factors(lake: Lake, as_of: date, lookback_days: int, force: bool, names: list[str] | None,
                    warmup_days: int | None, grain: list[str] | None, plugins: list[PandasFactor]) -> int:
    start = as_of - timedelta(days=lookback_days)
    end = as_of + timedelta(days=1)
    recent = lake.scan("daily", start, end, closed="left")
    last = _last_day(recent)
    if last is None:
        return 0
    done = lake.load_factors(start, end, names)
    gaps = missing_dates(recent, done, force, grain)
    span = gaps.agg(F.min("time").cast("date").alias("lo"), F.max("time").cast("date").alias("hi")).first()
    if span["lo"] is None:
        record_sync(lake, "factors", last, error_limit=FACTOR_ERRORS)
        return 0
    if warmup_days is None:
        computed = long_factors(carried_factors(lake, span["lo"], end, names, ends=False)[0], names)
    else:
        computed = compute_factors(lake.load_ohlcv(span["lo"] - timedelta(days=warmup_days), end), names)
    errors = []
    for plugin in plugins:
        first = None if warmup_days is None else span["lo"] - timedelta(days=warmup_days)
        found, failed = plugin.compute_isolated(lake.load_ohlcv(first, end))
        computed = computed.unionByName(found)
        errors += [f"{r['symbol']}: {plugin.name}: {r['error']}" for r in failed.orderBy("symbol").limit(FACTOR_ERRORS).collect()]
    rows = keep_dates(computed, gaps, grain)
    n = lake.upsert("daily_factors", rows)
    record_sync(lake, "factors", span["hi"], errors, error_limit=FACTOR_ERRORS)
    if errors:
        raise PartialRun(n, errors[:FACTOR_ERRORS])
    return n


def update_bars(lake: Lake, landed: DataFrame, calendar: DataFrame, as_of: date,
                lookback_days: int = LOOKBACK_DAYS, force: bool = False,
                order: str | list[str] | None = None) -> int:
    """Store landed vendor bars of the calendar days that have no bar; returns the row count.

    ``order`` names ingest sequence columns of ``landed`` for batches with repeated keys; by
    default those of ``landing.with_ingest``, if it has them. Only days of the run are read from
    the landing files.

    A day with a row that cannot be read is left out as a whole and stays a gap, so the next run tries it again; all
    other days are stored. Then the status names each such day, and ``PartialRun`` is raised. A run that fails
    otherwise leaves an error status and raises.
    """
    with reported(lake, "daily"):
        return _update_bars(lake, landed, calendar, as_of, lookback_days, force, order)


def _update_bars(lake: Lake, landed: DataFrame, calendar: DataFrame, as_of: date, lookback_days: int,
                 force: bool, order: str | list[str] | None) -> int:
    start = as_of - timedelta(days=lookback_days)
    end = as_of + timedelta(days=1)
    expected = in_range(calendar, "time", start, end, "left")
    gaps = missing_dates(expected, lake.scan("daily", start, end, closed="left"), force)
    order = [order] if isinstance(order, str) else order or ingest_order(landed)
    # The text of the day is what the files hold: this filter reaches their scan.
    recent = landed.filter(F.col("trade_date").between(start.strftime("%Y%m%d"), as_of.strftime("%Y%m%d")))
    failed = _failed_days(recent, gaps)
    days = F.coalesce(F.col("trade_date").isin([r["day"] for r in failed]), F.lit(False))
    good = ~days & unreadable(recent).isNull()
    # The join below parses the day in a filter of its own, which may run before the one here.
    readable = recent.filter(good).withColumn("trade_date", F.when(good, F.col("trade_date")))
    rows = keep_dates(normalize_bars(readable, order), gaps)
    n = lake.upsert("daily", rows, order)
    errors = [f"{r['day']}: {r['n']} rows cannot be read ({r['columns']})" for r in failed]
    record_sync(lake, "daily", _last_day(lake.scan("daily", start, end, closed="left")), errors)
    if errors:
        raise PartialRun(n, errors)
    return n


def _failed_days(landed: DataFrame, gaps: DataFrame) -> list[Row]:
    """One row for each gap with rows that cannot be read, and one for all rows whose day cannot be read."""
    bad = landed.withColumn("columns", unreadable(landed)).filter("columns is not null")
    bad = bad.withColumn("time", F.try_to_timestamp("trade_date", F.lit(VENDOR_DAY)))
    of_gaps = bad.filter("time is null").unionByName(keep_dates(bad.filter("time is not null"), gaps))
    day = F.when(F.col("time").isNull(), F.lit(NO_DAY)).otherwise(F.col("trade_date"))
    return of_gaps.groupBy(day.alias("day")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("columns")), ",").alias("columns"),
    ).orderBy("day").collect()


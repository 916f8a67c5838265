"""Exports: dense feature panel, trading calendar, instrument list and IC report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.functions.scalars import ISO_DAY, fmt_day, to_naive_day, to_prefix_code
from factorlake.operators.aggregates import calendar, instruments
from factorlake.operators.columns import in_universe
from factorlake.operators.joins import align_calendar

# Exported field and the bar column it comes from.
FIELDS = {"open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume",
          "factor": "adj_factor", "change": "pct_change"}


def scan_export(bars: DataFrame, symbols=None) -> DataFrame:
    """Bars with an open, at naive midnight, missing factor as 1 and missing change as 0."""
    factor = F.col("adj_factor").cast("double") if "adj_factor" in bars.columns else F.lit(None)
    return in_universe(bars.filter(F.col("open").isNotNull()), "symbol", symbols).select(
        to_naive_day("time").alias("time"), "symbol", "open", "high", "low", "close", "volume",
        F.coalesce(factor, F.lit(1.0)).alias("adj_factor"),
        F.coalesce(F.col("pct_change").cast("double"), F.lit(0.0)).alias("pct_change"),
    )


def dense_panel(exported: DataFrame, fields: dict[str, str] | None = None,
                as_arrays: bool = False, bound: int | None = None) -> DataFrame:
    """Every instrument on every trading day; with ``as_arrays`` one float array per field.

    An array has one element per trading day, in calendar order, null where there is no bar.
    """
    fields = fields or FIELDS
    grid = align_calendar(exported.select("time", "symbol", *fields.values()), calendar(exported), bound)
    code = F.lower(to_prefix_code("symbol")).alias("instrument")
    panel = grid.select("time", code, *[F.col(c).cast("double").alias(n) for n, c in fields.items()])
    if not as_arrays:
        return panel
    rows = F.sort_array(F.collect_list(F.struct("time", *fields)))
    arrays = panel.groupBy("instrument").agg(rows.alias("rows"))
    return arrays.select("instrument", *[
        F.col("rows").getField(n).cast("array<float>").alias(n) for n in fields])


def calendar_lines(exported: DataFrame) -> DataFrame:
    return calendar(exported).select(fmt_day("time", ISO_DAY).alias("value")).orderBy("value")


def instrument_lines(exported: DataFrame) -> DataFrame:
    return instruments(exported).select(
        to_prefix_code("symbol").alias("code"), fmt_day("start", ISO_DAY).alias("start"),
        fmt_day("end", ISO_DAY).alias("end"))


def write_calendar(exported: DataFrame, path: str) -> None:
    """One ISO date per line, ascending, in one file (a calendar is small)."""
    calendar_lines(exported).coalesce(1).write.mode("overwrite").text(path)


def write_instruments(exported: DataFrame, path: str) -> None:
    """Tab-separated code, first and last day."""
    instrument_lines(exported).orderBy("code").write.mode("overwrite").option(
        "sep", "\t").csv(path)


def write_report(summary: DataFrame, path: str) -> None:
    """IC report as CSV with a header (one row per lag and factor, so one file)."""
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)

"""Calendars, symbol lists, group statistics and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.functions.scalars import VENDOR_DAY, fmt_day
from factorlake.functions.stats import safe_corr
from factorlake.operators.columns import in_range
from factorlake.operators.ranks import median_of, value_counts
from factorlake.session import durable


def symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct().orderBy("symbol")


def n_symbols(bars: DataFrame) -> DataFrame:
    """Distinct count in two steps, so that no task holds every symbol."""
    return bars.select("symbol").distinct().agg(F.count("symbol").alias("n_symbols"))


def trading_dates(bars: DataFrame, start=None, end=None) -> DataFrame:
    """Distinct days in the inclusive range as ``yyyyMMdd`` text, ascending."""
    days = in_range(bars, "time", start, end)
    return days.select(fmt_day("time", VENDOR_DAY).alias("trade_date")).distinct().orderBy(
        "trade_date")


def calendar(bars: DataFrame) -> DataFrame:
    return bars.select("time").distinct()


def calendar_from(bars: DataFrame, ref_symbol: str) -> DataFrame:
    """Trading days taken from one liquid symbol."""
    return calendar(bars.filter(F.col("symbol") == ref_symbol))


def instruments(bars: DataFrame) -> DataFrame:
    """First and last bar of each symbol."""
    return bars.groupBy("symbol").agg(F.min("time").alias("start"), F.max("time").alias("end"))


def global_ic(wide: DataFrame, names: list[str], ret: str = "fwd_ret") -> DataFrame:
    """Pearson correlation of each factor with the return over all rows, one row per factor."""
    pairs = wide.unpivot([ret], names, "factor_name", "factor_value").na.drop()
    return pairs.groupBy("factor_name").agg(safe_corr("factor_value", ret).alias("ic"))


def count_by(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row with the number of rows that meet each condition."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def group_stats(panel: DataFrame, by: str, ret: str, bound: int | None = None) -> DataFrame:
    """Count, mean, median, deviation and win rate of ``ret`` per value of ``by``, ordered.

    The panel is read once, for the counts of its values; all figures come from these.
    """
    counts = durable(value_counts(panel, [by], ret))
    n, value = F.col("__n"), F.col(ret).cast("double")
    there = F.when(value.isNotNull(), n)
    means = counts.groupBy(by).agg(
        F.sum(n).alias("count"), F.sum(there).alias("__known"),
        F.try_divide(F.sum(value * n), F.sum(there)).alias("mean_ret"),
        F.try_divide(F.sum(F.when(value > 0, n)), F.sum(there)).alias("__won"))
    # Deviations are taken from the mean itself, not from sums of squares.
    spread = counts.join(means.select(by, "mean_ret"), by).groupBy(by).agg(
        F.sum(n * F.pow(value - F.col("mean_ret"), F.lit(2.0))).alias("__squares"))
    stats = means.join(spread, by, "left").select(
        by, "count", "mean_ret",
        F.when(F.col("__known") > 1, F.sqrt(F.col("__squares") / (F.col("__known") - 1))).alias("std_ret"),
        F.when(F.col("__known") > 0, F.coalesce("__won", F.lit(0.0))).alias("win_rate"))
    median = median_of(counts, [by], ret, bound).withColumnRenamed("median", "median_ret")
    return stats.join(median, by, "left").orderBy(by)


def histogram(df: DataFrame, c: str, bins: int, limits: tuple[float, float] | None = None,
              density: bool = False, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins with an inclusive top edge; values out of range are left out.

    Without ``limits`` the range is that of the data. Empty bins have no row. With
    ``density`` the bars of each group of ``by`` integrate to one.
    """
    by = by or []
    values = df.filter(F.col(c).isNotNull()).select(*by, F.col(c).cast("double").alias(c))
    if limits is None:
        values = durable(values)  # read for its range and again for the counts
        ends = values.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias("ends")).scalar()
        lo, hi = ends["lo"], ends["hi"]
    else:
        lo, hi = F.lit(float(limits[0])), F.lit(float(limits[1]))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = (
        values.withColumns({"lo": lo, "hi": hi})
        .filter(F.col(c).between(F.col("lo"), F.col("hi")))
        .withColumn("bin", F.least(F.width_bucket(c, "lo", "hi", F.lit(bins)), F.lit(bins)) - 1)
    )
    counts = binned.groupBy(*by, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("count"))
    out = [*by, F.col("bin").cast("long").alias("bin"),
           (F.col("lo") + F.col("bin") * width).alias("left"), "count"]
    if not density:
        return counts.select(*out)
    totals = binned.groupBy(*by).agg(F.count(F.lit(1)).alias("__in_range"))
    joined = counts.join(totals, by) if by else counts.withColumn("__in_range", totals.scalar())
    return joined.select(*out, (F.col("count") / (F.col("__in_range") * width)).alias("density"))

"""Panel joins. None carries a broadcast hint: Spark broadcasts a side only when its size
estimate is under the session threshold, and otherwise sort-merges with skew splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.operators.ordered import Series, over_series

PANEL = ["time", "symbol"]


def join_panel(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join of two tables keyed by (time, symbol)."""
    return left.join(right, PANEL)


def attach_dim(df: DataFrame, dim: DataFrame | None, on: str, fill: dict[str, object]) -> DataFrame:
    """Left join of a dimension; missing attributes, columns or a missing dimension get ``fill``."""
    known = [c for c in fill if dim is not None and c in dim.columns]
    absent = {c: F.lit(v) for c, v in fill.items() if c not in known}
    if known:
        df = df.join(dim.select(on, *known), on, "left").na.fill({c: fill[c] for c in known})
    return df.withColumns(absent) if absent else df


def missing_dates(expected: DataFrame, existing: DataFrame, force: bool = False,
                  grain: list[str] | None = None) -> DataFrame:
    """Expected keys (dates by default) that do not exist yet; all of them with ``force``."""
    grain = grain or ["time"]
    wanted = expected.select(*grain).distinct()
    return wanted if force else wanted.join(existing.select(*grain).distinct(), grain, "left_anti")


def keep_dates(df: DataFrame, dates: DataFrame, grain: list[str] | None = None) -> DataFrame:
    return df.join(dates, grain or ["time"], "left_semi")


def align_calendar(bars: DataFrame, calendar: DataFrame, bound: int | None = None) -> DataFrame:
    """Every symbol on every calendar day; days without a bar have null values.

    Each bar gives the days from its own to the one before the symbol's next bar, and a first bar also
    those before it, so that only bars are shuffled and nothing is joined. The calendar is one
    array (an element per trading day, so its size is bounded by the date range); bars of other days are left out.
    """
    days = calendar.agg(F.sort_array(F.collect_set("time")).alias("days")).scalar()
    values = [c for c in bars.columns if c not in PANEL]
    placed = bars.withColumn("__at", F.array_position(days, F.col("time")).cast("int")).filter(F.col("__at") > 0)

    def add(df: DataFrame, series: Series) -> DataFrame:
        return df.select("*", series.prev("__at").alias("__before"), series.ahead("__at").alias("__next"))

    rows = over_series(placed, add, by=["symbol"], order="time", before=1, after=1, bound=bound)
    first = F.when(F.col("__before").isNull(), 1).otherwise(F.col("__at"))
    # Bars of one day each give that day, the last of them the days that follow.
    count = F.greatest(F.coalesce("__next", F.size(days) + 1), F.col("__at") + 1) - first
    own = F.explode(F.slice(days, first, count)).alias("__day")
    there = F.col("__day") == F.col("time")
    return rows.select("symbol", "time", own, *values).select(
        F.col("__day").alias("time"), "symbol", *[F.when(there, F.col(c)).alias(c) for c in values])

"""Weekly, monthly and intraday bars from finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.functions.scalars import bucket

# Bar frequencies of the minute table.
MINUTE_FREQS = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "60m": 60}


def ohlcv(order: str = "time") -> list[Column]:
    """Open by first, close by last in ``order``; partial results combine before the shuffle."""
    return [
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"),
    ]


def resample(bars: DataFrame, unit: str) -> DataFrame:
    """Bars per week (from Monday) or month; ``time`` is the start of the bucket."""
    return (
        bars.groupBy(bucket("time", unit).alias("bucket"), "symbol")
        .agg(*ohlcv())
        .withColumnRenamed("bucket", "time")
    )


def resample_minutes(bars: DataFrame, freq: str) -> DataFrame:
    """Minute bars at ``freq`` from finer ones."""
    if freq not in MINUTE_FREQS:
        raise ValueError(f"unknown freq {freq!r}; one of {', '.join(MINUTE_FREQS)}")
    window = F.window("time", f"{MINUTE_FREQS[freq]} minutes")
    return (
        bars.groupBy(window.alias("w"), "symbol")
        .agg(*ohlcv())
        .select(F.col("w.start").alias("time"), "symbol", F.lit(freq).alias("freq"),
                "open", "high", "low", "close", "volume", "amount")
    )

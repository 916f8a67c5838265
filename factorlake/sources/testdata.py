"""Panel inputs derived from the star-schema test tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.operators.ordered import over_series


class PanelBounds(NamedTuple):
    """Proven upper bounds of the window partitions of a bar panel."""

    per_symbol: int
    per_date: int


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(key: Column) -> Column:
    """Six digits or more, then the exchange: even keys SZ, odd keys SH."""
    digits = key.cast("string")
    padded = F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)
    return F.concat(padded, F.when(key % 2 == 0, ".SZ").otherwise(".SH"))


def ticks(lineitem: DataFrame) -> DataFrame:
    """Line items as trades: symbol, day, price, quantity and a total order inside the day.

    The order (order, line, discount, tax) is packed into one long so that first and last
    price run as hash aggregates; equal codes have equal prices.
    """
    cents = [F.round(F.col(c) * 100).cast("long") for c in ("l_discount", "l_tax")]
    code = (F.col("l_orderkey") * 16 + F.col("l_linenumber")) * 256 + cents[0] * 16 + cents[1]
    return lineitem.select(
        F.col("l_shipdate").cast("timestamp").alias("time"),
        F.col("l_suppkey").alias("suppkey"),
        F.round(100 * (1 + F.col("l_discount") - F.col("l_tax")), 2).alias("price"),
        F.col("l_quantity").alias("quantity"),
        code.alias("tick"),
    )


def raw_bars(trades: DataFrame) -> DataFrame:
    """One bar per symbol and day, without the change to the previous bar."""
    return (
        trades.groupBy("suppkey", "time")
        .agg(
            F.min_by("price", "tick").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "tick").alias("close"),
            F.sum("quantity").cast("long").alias("volume"),
            F.sum(F.col("price") * F.col("quantity")).alias("amount"),
        )
        .select("time", symbol_of(F.col("suppkey")).alias("symbol"),
                "open", "high", "low", "close", "volume", "amount")
    )


def with_pct_change(bars: DataFrame, bound: int | None = None) -> DataFrame:
    def add(df, series):
        ratio = F.try_divide(F.col("close"), series.prev("close"))
        return df.withColumn("pct_change", 100 * (ratio - 1))

    return over_series(bars, add, by=["symbol"], order="time", before=1, bound=bound)


def panel_bounds(spark: SparkSession, sf_dir: str) -> PanelBounds:
    """Bars are unique per (symbol, day), so a symbol has no more rows than there are days,
    and a day no more than there are symbols."""
    ends = table(spark, sf_dir, "lineitem").agg(
        F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).alias("days"),
        (F.max("l_suppkey") - F.min("l_suppkey")).alias("keys"),
    ).first()
    return PanelBounds((ends["days"] or 0) + 1, (ends["keys"] or 0) + 1)


def daily_bars(spark: SparkSession, sf_dir: str, bound: int | None = None) -> DataFrame:
    """time, symbol, open, high, low, close, volume, amount, pct_change."""
    if bound is None:
        bound = panel_bounds(spark, sf_dir).per_symbol
    return with_pct_change(raw_bars(ticks(table(spark, sf_dir, "lineitem"))), bound)


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock dimension with the ST flag."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        symbol_of(key).alias("symbol"),
        F.col("s_name").alias("name"),
        F.when(key % 2 == 0, "SZ").otherwise("SH").alias("exchange"),
        (F.col("s_acctbal") < 0).cast("int").alias("is_st"),
    )


def index_daily(bars: DataFrame, symbol: str = "000300.SH") -> DataFrame:
    """Equal-weight benchmark: mean change per day."""
    return bars.groupBy("time").agg(F.avg("pct_change").alias("pct_change")).select(
        "time", F.lit(symbol).alias("symbol"), "pct_change")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one-trade bars per event type."""
    price = [F.col("value").alias(c) for c in ("open", "high", "low", "close")]
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("time"), "event_id",
        F.col("event_type").alias("symbol"), *price,
        F.lit(1).cast("long").alias("volume"), F.col("value").alias("amount"),
    )

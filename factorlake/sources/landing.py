"""Landed vendor bars: text dates, vendor column names, one row per symbol and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions.scalars import VENDOR_DAY, fmt_day, parse_day
from factorlake.operators.columns import in_range, in_universe

# Vendor column names, output columns and the landing schema.
VENDOR_NAMES = {"ts_code": "symbol", "trade_date": "time", "vol": "volume", "pct_chg": "pct_change"}
BAR_COLUMNS = ["time", "symbol", "open", "high", "low", "close", "volume", "amount", "pct_change"]
LANDING_SCHEMA = ("ts_code string, trade_date string, open double, high double, low double, "
                  "close double, pct_chg double, vol double, amount double")


# Where a landed row comes from: later files, and later rows of a file, replace earlier ones.
INGEST = ["ingest_time", "ingest_file", "ingest_row"]


def with_ingest(landed: DataFrame) -> DataFrame:
    """Add the ingest order of rows that were read from files."""
    meta = ("file_modification_time", "file_path", "row_index")
    return landed.select("*", *[F.col(f"_metadata.{m}").alias(c) for m, c in zip(meta, INGEST)])


def ingest_order(df: DataFrame) -> list[str]:
    return [c for c in INGEST if c in df.columns]


def unreadable(raw: DataFrame) -> Column:
    """The vendor columns of a row that hold no value of their kind, joined by commas; null where all can be read."""
    def number(c: str) -> Column:
        return F.col(c).try_cast("double")

    broken = {"ts_code": F.col("ts_code").isNull(), "trade_date": F.try_to_timestamp("trade_date", F.lit(VENDOR_DAY)).isNull()}
    for c in raw.columns:
        if VENDOR_NAMES.get(c, c) in BAR_COLUMNS and c not in broken:
            broken[c] = F.col(c).isNotNull() & number(c).isNull()
    volume = number("vol")
    broken["vol"] |= volume.isNotNull() & ~F.isnan(volume) & volume.try_cast("long").isNull()
    names = F.concat_ws(",", *[F.when(test, F.lit(c)) for c, test in broken.items()])
    return F.when(names != "", names)


def normalize_bars(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Vendor columns to bar columns: renamed, dates parsed, volume whole.

    ``keep`` names further columns to carry along, such as an ingest sequence; the columns of
    ``with_ingest`` are carried in any case.
    """
    keep = [*(keep or []), *[c for c in ingest_order(raw) if c not in (keep or [])]]
    volume = F.col("volume").cast("double")
    text = ("time", "symbol", "volume")
    return raw.withColumnsRenamed(VENDOR_NAMES).withColumns({
        "time": parse_day("time"),
        # Quantities such as 123.0 become whole numbers; NaN becomes null.
        "volume": F.when(~F.isnan(volume), volume).cast("long"),
        **{c: F.col(c).cast("double") for c in BAR_COLUMNS if c not in text},
    }).select(*BAR_COLUMNS, *keep)


def to_vendor(bars: DataFrame) -> DataFrame:
    """Bars in the landed form."""
    back = {v: k for k, v in VENDOR_NAMES.items()}
    return (
        bars.withColumn("time", fmt_day("time", VENDOR_DAY))
        .withColumn("volume", F.col("volume").cast("double"))
        .select("time", "symbol", "open", "high", "low", "close", "pct_change", "volume", "amount")
        .withColumnsRenamed(back)
    )


def scan_landing(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed files with their fixed schema (parquet, csv with header, or json)."""
    reader = spark.read.schema(LANDING_SCHEMA)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def scan_bars(bars: DataFrame, symbols=None, dates=None, start=None, end=None) -> DataFrame:
    """Bars of some symbols, some days, a range of days, or any mix of these."""
    return in_range(in_universe(in_universe(bars, "symbol", symbols), "time", dates),
                    "time", start, end)

"""Weekly and monthly bars kept up to date, in batch windows and from streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factorlake.functions.scalars import bucket
from factorlake.operators.resample import ohlcv, resample
from factorlake.schemas import TABLES
from factorlake.session import state_on_disk
from factorlake.sources.lake import Lake, as_double
from factorlake.sources.landing import ingest_order
from factorlake.streaming.ledger import Ledger

# Refresh windows in days (start and end offset from now).
REFRESH_DAYS = {"week": (21, 1), "month": (92, 1)}
VIEWS = {"week": "weekly", "month": "monthly"}


def _bucket_start(day: date, unit: str) -> date:
    return day - timedelta(days=day.weekday() if unit == "week" else day.day - 1)


def refresh_window(lake: Lake, unit: str, as_of: date, start_days: int | None = None,
                   end_days: int | None = None) -> None:
    """Recompute the buckets that the days between the two offsets before ``as_of`` fall into.

    Only whole buckets are written: the window is widened to the start of its first bucket and
    the end of its last one, so a stored bucket is never replaced by a part of itself.
    """
    default = REFRESH_DAYS[unit]
    first = as_of - timedelta(days=start_days if start_days is not None else default[0])
    last = as_of - timedelta(days=end_days if end_days is not None else default[1])
    if last <= first:
        return
    # 31 days after the start of a month and 7 after a Monday lie in the next bucket.
    final = _bucket_start(last - timedelta(days=1), unit)
    end = _bucket_start(final + timedelta(days=7 if unit == "week" else 31), unit)
    bars = as_double(lake.scan("daily", _bucket_start(first, unit), end, closed="left"))
    lake.upsert(VIEWS[unit], resample(bars, unit))


def _stream(bars: DataFrame, lake: Lake, checkpoint: str, unit: str, once: bool) -> StreamingQuery:
    """Store daily bars as they arrive and recompute the buckets they fall into from stored bars.

    No state and no watermark: a bar may be as late as it likes.
    """

    def refresh(rows: DataFrame, _: int) -> None:
        with lake.staged(rows) as rows:
            if not lake.upsert("daily", rows, ingest_order(rows), staged=True):
                return
            buckets = rows.select(bucket("time", unit).alias("bucket")).distinct()
            ends = buckets.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).first()
            if ends["lo"] is None:
                return
            stored = lake.scan("daily", ends["lo"].date(), ends["hi"].date() + timedelta(days=31))
            touched = (as_double(stored).withColumn("bucket", bucket("time", unit))
                       .join(buckets, "bucket", "left_semi"))
            lake.upsert(VIEWS[unit], resample(touched, unit))

    return _start(bars, checkpoint, once, refresh, mode="append")


def stream_weekly(bars: DataFrame, lake: Lake, checkpoint: str, once: bool = True,
                  watermark: timedelta | None = None) -> StreamingQuery | WatermarkedRollup:
    """Keep the weekly table current from a stream of daily bars; with ``watermark`` see ``stream_closed``."""
    if watermark is not None:
        return stream_closed(bars, lake, checkpoint, "week", watermark, once)
    return _stream(bars, lake, checkpoint, "week", once)


def stream_monthly(bars: DataFrame, lake: Lake, checkpoint: str, once: bool = True,
                   watermark: timedelta | None = None) -> StreamingQuery | WatermarkedRollup:
    """Keep the monthly table current from a stream of daily bars; with ``watermark`` see ``stream_closed``."""
    if watermark is not None:
        return stream_closed(bars, lake, checkpoint, "month", watermark, once)
    return _stream(bars, lake, checkpoint, "month", once)


BUCKET_BAR = ["time", "symbol", "open", "high", "low", "close", "volume", "amount"]


def _event(unit: str) -> Column:
    """What lateness is measured by: the bar's time, or for a month, whose length varies, its end."""
    return F.col("time") if unit == "week" else bucket("time", unit) + F.make_ym_interval(F.lit(0), F.lit(1))


def _delay(unit: str, watermark: timedelta) -> timedelta:
    """At the end of a month, bars of its first day are as late as the month is long."""
    return watermark if unit == "week" else watermark + timedelta(days=31)


@dataclass(frozen=True)
class WatermarkedRollup:
    """The two queries of a rollup with a watermark."""

    admitted: StreamingQuery
    closed: StreamingQuery

    def awaitTermination(self) -> None:
        self.admitted.awaitTermination()
        self.closed.awaitTermination()

    def stop(self) -> None:
        self.admitted.stop()
        self.closed.stop()


def stream_closed(bars: DataFrame, lake: Lake, checkpoint: str, unit: str, watermark: timedelta,
                  once: bool = True) -> WatermarkedRollup:
    """Buckets that are written once, when the watermark has passed their end.

    The first query admits bars: those up to ``watermark`` older than the newest bar of earlier batches (for
    months, measured by the month's end and a month more). Later ones go to the table ``late_bars``, with
    the name of the view that misses them. The second query aggregates admitted bars as state of the streaming engine
    in append mode; its watermark is never ahead of the first one's, so it drops no admitted bar. It keeps open
    buckets only, and no daily bar. A bar that is delivered twice counts once, the first one.
    """
    spark, view, delay = bars.sparkSession, VIEWS[unit], _delay(unit, watermark)
    accepted, progress = f"{checkpoint}/accepted", f"{checkpoint}/progress"
    schema = as_double(spark.createDataFrame([], TABLES[view].schema)).select(BUCKET_BAR).schema

    def newest(batch: int):
        """The newest event up to a batch, null before the first one."""
        try:
            return spark.read.schema("event timestamp").parquet(f"{progress}/batch={batch}").first()
        except AnalysisException:  # no such batch
            return None

    def admit(rows: DataFrame, batch: int) -> None:
        if newest(batch) is not None:
            return  # done before
        with lake.staged(rows.withColumn("__event", _event(unit)).filter(F.col("__event").isNotNull())) as rows:
            earlier = newest(batch - 1) if batch else None
            known = earlier and earlier["event"]
            late = F.lit(False) if known is None else F.col("__event") <= F.lit(known - delay)
            lake.upsert("late_bars", rows.filter(late).withColumn("view", F.lit(view)), ingest_order(rows), staged=True)
            fresh = as_double(rows.filter(~late)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
            fresh.write.mode("overwrite").parquet(f"{accepted}/batch={batch}")
            top = rows.agg(F.greatest(F.max("__event"), F.lit(known).cast("timestamp")).alias("event"))
            top.write.mode("overwrite").parquet(f"{progress}/batch={batch}")

    state_on_disk(spark)
    # A folder that holds no batch yet can be listed by the second query.
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{accepted}/batch=-1")
    first = _start(bars, f"{checkpoint}/admit", once, admit, mode="append")
    if once:
        first.awaitTermination()
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(accepted)
    seconds = f"{int(delay.total_seconds())} seconds"
    rows = rows.withColumn("event", _event(unit)).withWatermark("event", seconds).dropDuplicatesWithinWatermark(
        ["time", "symbol"])
    # Weeks start on Mondays: four days after the first of 1970.
    key = F.window("event", "7 days", startTime="4 days") if unit == "week" else F.col("event")
    start = F.col("bucket.start") if unit == "week" else F.col("bucket") - F.make_ym_interval(F.lit(0), F.lit(1))
    closed = rows.groupBy(key.alias("bucket"), "symbol").agg(*ohlcv()).withColumn("time", start).drop("bucket")
    second = _start(closed, f"{checkpoint}/close", once, lambda part, _: lake.upsert(view, part), mode="append")
    return WatermarkedRollup(first, second)


def _start(df: DataFrame, checkpoint: str, once: bool, write: Callable, mode: str,
           ledger: Ledger | None = None) -> StreamingQuery:
    def run(rows: DataFrame, batch: int) -> None:
        if ledger is None:
            write(rows, batch)
        else:
            ledger.once(write, rows, batch)

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer).start()

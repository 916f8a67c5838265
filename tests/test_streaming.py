from datetime import date, datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from factorlake.operators.resample import MINUTE_FREQS, resample, resample_minutes
from factorlake.plans.factors import compute_factors
from factorlake.sources.lake import Lake, as_double
from factorlake.sources.landing import normalize_bars, to_vendor
from factorlake.streaming import ingest, rollups

BAR = ["time", "symbol", "open", "high", "low", "close", "volume", "amount"]


@pytest.fixture
def bars(make_bars):
    return make_bars({s: [float(50 + (k * n) % 13) for k in range(100)] for n, s in enumerate("abc", 3)}).withColumn(
        "pct_change", F.lit(0.5))


@pytest.fixture
def drops(bars, folder):
    """Four landed files, oldest first."""
    for k in range(4):
        lo, hi = f"2024-{k + 1:02d}-01", f"2024-{k + 2:02d}-01"
        part = bars.filter((F.col("time") >= lo) & (F.col("time") < hi))
        to_vendor(part).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    return f"{folder}/landing"


def stream(spark, path):
    return ingest.read_landing(spark, path, files_per_batch=1)


def test_bars_stream_upserts_every_file(spark, bars, drops, folder):
    lake = Lake(spark, f"{folder}/lake")
    ingest.stream_bars(stream(spark, drops), lake, f"{folder}/cp").awaitTermination()
    assert rows_of(as_double(lake.scan("daily")).select(BAR)) == rows_of(bars.select(BAR))
    # A second run sees no new file; a repeated file changes nothing.
    ingest.stream_bars(stream(spark, drops), lake, f"{folder}/cp").awaitTermination()
    assert lake.scan("daily").count() == bars.count()


def test_weekly_stream_equals_batch_however_late_a_bar_is(spark, bars, drops, folder):
    lake = Lake(spark, f"{folder}/lake")

    def run():
        rollups.stream_weekly(normalize_bars(stream(spark, drops)), lake, f"{folder}/cp").awaitTermination()

    run()
    batch = rows_of(resample(bars, "week").select(BAR))
    assert rows_of(as_double(lake.scan("weekly")).select(BAR)) == batch
    # Ten and sixty days back.
    late = bars.filter(F.col("time").isin([F.lit(d).cast("timestamp") for d in ("2024-03-30", "2024-02-05")]))
    to_vendor(late.withColumn("high", F.lit(999.0))).coalesce(1).write.mode("append").parquet(drops)
    run()
    highs = {r["time"].date() for r in lake.scan("weekly").filter("high = 999").collect()}
    assert highs == {date(2024, 3, 25), date(2024, 2, 5)}
    week = as_double(lake.scan("weekly")).filter("time = '2024-02-05'").select(*BAR[2:])
    again = resample(as_double(lake.scan("daily")), "week").filter("time = '2024-02-05'").select(*BAR[2:])
    assert rows_of(week) == rows_of(again)


def test_monthly_stream_equals_batch(spark, bars, drops, folder):
    lake = Lake(spark, f"{folder}/lake")
    source = normalize_bars(stream(spark, drops))
    rollups.stream_monthly(source, lake, f"{folder}/cp").awaitTermination()
    assert rows_of(as_double(lake.scan("monthly")).select(BAR)) == rows_of(resample(bars, "month").select(BAR))


def test_factor_stream_equals_full_run(spark, bars, drops, folder):
    lake = Lake(spark, f"{folder}/lake")
    source = normalize_bars(stream(spark, drops))
    names = ["price_to_ma20", "rsi14", "limit_up"]
    ingest.stream_factors(source, lake, f"{folder}/cp", names).awaitTermination()
    assert rows_of(lake.scan("daily_factors")) == rows_of(compute_factors(bars, names))


def test_late_day_leaves_no_stale_factor(spark, bars, folder):
    """A day lands after the days that depend on it."""
    late = F.col("time") == "2024-02-10"
    for part in (bars.filter(~late), bars.filter(late)):
        to_vendor(part).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    lake = Lake(spark, f"{folder}/lake")
    names = ["price_to_ma20", "ma_cross", "rsi14"]
    source = normalize_bars(stream(spark, f"{folder}/landing"))
    ingest.stream_factors(source, lake, f"{folder}/cp", names).awaitTermination()
    assert rows_of(lake.scan("daily_factors")) == rows_of(compute_factors(bars, names))


def test_repeated_keys_in_a_batch_take_the_last_row_whole(spark, bars, folder):
    one = bars.filter("symbol = 'a'").limit(3)
    to_vendor(one.withColumn("close", F.lit(7.0))).coalesce(1).write.mode("append").parquet(f"{folder}/l")
    to_vendor(one.withColumn("high", F.lit(None).cast("double"))).coalesce(1).write.mode("append").parquet(f"{folder}/l")
    lake = Lake(spark, f"{folder}/lake")
    ingest.stream_bars(ingest.read_landing(spark, f"{folder}/l"), lake, f"{folder}/cp").awaitTermination()
    got = as_double(lake.scan("daily")).select("time", "close", "high")
    assert rows_of(got) == rows_of(one.select("time", "close", F.lit(None).cast("double").alias("high")))


def test_refresh_window_rewrites_whole_buckets(spark, bars, folder):
    lake = Lake(spark, f"{folder}/lake")
    lake.upsert("daily", bars)
    lake.upsert("weekly", resample(bars, "week"))
    rollups.refresh_window(lake, "week", date(2024, 3, 21))
    assert rows_of(as_double(lake.scan("weekly")).select(BAR)) == rows_of(resample(bars, "week").select(BAR))
    lake = Lake(spark, f"{folder}/other")
    lake.upsert("daily", bars)
    rollups.refresh_window(lake, "week", date(2024, 3, 21))
    weekly = {r["time"].date() for r in lake.scan("weekly").collect()}
    assert weekly == {date(2024, 2, 26), date(2024, 3, 4), date(2024, 3, 11), date(2024, 3, 18)}
    rollups.refresh_window(lake, "month", date(2024, 4, 10))
    got = as_double(lake.scan("monthly")).filter("time < '2024-04-01'").select(BAR)
    assert rows_of(got) == rows_of(resample(bars, "month").filter("time < '2024-04-01'").select(BAR))


def test_minutes_and_unknown_units(make_bars):
    bars = make_bars({"a": [1.0, 3.0, 2.0, 5.0, 4.0]}).withColumn(
        "time", F.expr("timestamp'2024-01-01 09:58:00' + make_interval(0,0,0,0,0,dayofmonth(time))"))
    got = resample_minutes(bars, "5m").orderBy("time").collect()
    assert [(r["time"].minute, r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got] == [
        (55, 1.0, 1.0, 1.0, 1.0, 100), (0, 3.0, 5.0, 2.0, 4.0, 400)]
    with pytest.raises(ValueError, match=", ".join(MINUTE_FREQS)):
        resample_minutes(bars, "7m")
    with pytest.raises(ValueError, match="week, month"):
        resample(bars, "year")


@pytest.mark.parametrize("unit,watermark", [("week", 7), ("month", 3)])
def test_watermarked_rollup_closes_buckets_and_sets_late_bars_apart(spark, bars, drops, folder, unit, watermark):
    lake, view = Lake(spark, f"{folder}/lake"), rollups.VIEWS[unit]

    def run():
        rollups.stream_closed(normalize_bars(stream(spark, drops)), lake, f"{folder}/cp", unit,
                              timedelta(days=watermark)).awaitTermination()

    run()
    batch = resample(bars, unit)
    got = as_double(lake.scan(view)).select(BAR)
    # Bars run to 2024-04-09; a bucket is written once it ended more than the watermark before that.
    end = {"week": datetime(2024, 4, 9) - timedelta(days=7 + watermark), "month": datetime(2024, 2, 20)}[unit]
    assert rows_of(got) == rows_of(batch.filter(F.col("time") <= F.lit(end)).select(BAR))
    assert lake.scan("late_bars").count() == 0
    # One bar of an open bucket, one of a closed one, and one that was delivered before.
    def land(day, high):
        row = bars.filter((F.col("time") == day) & (F.col("symbol") == "a")).withColumn("high", F.lit(high))
        to_vendor(row).coalesce(1).write.mode("append").parquet(drops)

    land("2024-01-10", 999.0)
    land("2024-04-08", 999.0)
    new = bars.filter("symbol = 'a'").limit(1).withColumn("time", F.lit("2024-06-30").cast("timestamp"))
    to_vendor(new).coalesce(1).write.mode("append").parquet(drops)
    run()
    late = lake.scan("late_bars").select("view", F.col("time").cast("date"), "symbol").collect()
    assert [tuple(r) for r in late] == [(view, date(2024, 1, 10), "a")]
    got = as_double(lake.scan(view)).select(BAR)
    assert rows_of(got) == rows_of(batch.select(BAR))  # nothing counts twice, nothing late gets in


def test_factor_stream_reads_two_months_of_an_on_time_batch(spark, make_bars, folder, monkeypatch):
    """A year of bars, then a current day, then a day that is late by months; the same as a full run."""
    bars = make_bars({s: [float(50 + (k * n) % 17) for k in range(366)] for n, s in enumerate("abc", 3)}).withColumn(
        "pct_change", F.lit(0.5))
    names = ["price_to_ma20", "ma_cross", "rsi14", "macd_norm", "limit_up"]
    late = (F.col("time") == "2024-05-17") & (F.col("symbol") == "b")
    last = F.col("time") >= "2024-12-30"
    lake, scans = Lake(spark, f"{folder}/lake"), []
    scan = lake.scan

    def counted(name, *args, **kw):
        df = scan(name, *args, **kw)
        if name == "daily":
            scans.append({r[0].split("ym=")[1][:7] for r in df.select(F.input_file_name()).distinct().collect()})
        return df

    monkeypatch.setattr(lake, "scan", counted)
    for part in (~late & ~last, last & (F.col("time") < "2024-12-31"), F.col("time") == "2024-12-31", late):
        to_vendor(bars.filter(part)).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
        scans.clear()
        source = normalize_bars(stream(spark, f"{folder}/landing"))
        ingest.stream_factors(source, lake, f"{folder}/cp", names).awaitTermination()
    assert rows_of(lake.scan("daily_factors")) == rows_of(compute_factors(bars, names))
    # One more day: only its month and the one before are read.
    more = make_bars({"a": [60.0]}, start="2025-01-01").withColumn("pct_change", F.lit(0.5))
    to_vendor(more).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    ingest.stream_factors(normalize_bars(stream(spark, f"{folder}/landing")), lake, f"{folder}/cp", names).awaitTermination()
    more = make_bars({"a": [61.0]}, start="2025-01-02").withColumn("pct_change", F.lit(0.5))
    to_vendor(more).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    scans.clear()
    ingest.stream_factors(normalize_bars(stream(spark, f"{folder}/landing")), lake, f"{folder}/cp", names).awaitTermination()
    on_time = set().union(*scans)
    assert on_time == {"2024-12", "2025-01"}
    whole = as_double(lake.scan("daily")).select("time", "symbol", "open", "high", "low", "close", "volume")
    assert rows_of(lake.scan("daily_factors")) == rows_of(compute_factors(whole, names))


def test_a_batch_that_is_run_again_changes_nothing(spark, bars, drops, folder, monkeypatch):
    """A crash after the ledger was written and before the stream's own commit."""
    from factorlake.streaming.ledger import Ledger
    lake = Lake(spark, f"{folder}/lake")
    ingest.stream_bars(stream(spark, drops), lake, f"{folder}/cp").awaitTermination()
    ledger = Ledger(lake, f"{folder}/cp", "daily")
    before = ledger.finished()
    assert (before["batch"], before["last_date"]) == (3, date(2024, 4, 9))
    status = rows_of(lake.scan("sync_status"))
    newer = bars.filter("symbol = 'a'").withColumn("close", F.lit(1.0))
    lake.upsert("daily", newer)
    stored = rows_of(lake.scan("daily"))
    ledger.once(lambda rows, _: lake.upsert("daily", rows), bars, 3)
    assert rows_of(lake.scan("daily")) == stored
    assert rows_of(lake.scan("sync_status")) == status
    assert ledger.finished() == before
    # A crash between the tables and the ledger: the batch is upserted again by key, and counted once.
    monkeypatch.setattr(Ledger, "_note", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        ledger.once(lambda rows, _: lake.upsert("daily", rows), newer, 4)
    monkeypatch.undo()
    ledger.once(lambda rows, _: lake.upsert("daily", rows), newer, 4)
    assert rows_of(lake.scan("daily")) == stored
    assert ledger.finished()["n_rows"] == newer.count()

from datetime import date, datetime

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from factorlake.functions import join_errors, metadata_to_json
from factorlake.plans.factors import DEFAULT_NAMES, PandasFactor, compute_factors
from factorlake.plans.incremental import update_bars, update_factors
from factorlake.sources import export
from factorlake.sources.lake import Lake, as_double
from factorlake.sources.landing import normalize_bars, scan_bars, scan_landing, to_vendor
from factorlake.sources.status import PartialRun, record_sync
from factorlake.sources.upsert import merge
from factorlake.session import bound_tasks


@pytest.fixture
def lake(spark, folder):
    return Lake(spark, folder)


@pytest.fixture
def bars(make_bars):
    return make_bars({"000001.SZ": [10.0 + k for k in range(40)], "000002.SH": [20.0] * 40}).withColumn(
        "pct_change", F.lit(1.5))


def test_merge_is_last_wins_null_safe_and_partial(spark):
    base = spark.createDataFrame([(1, None, 10, 7), (2, "x", 20, 8)], "a int, b string, v int, keep int")
    new = spark.createDataFrame([(1, None, 11, 1), (1, None, 12, 2), (3, "y", 30, 1)], "a int, b string, v int, seq int")
    out = merge(base, new, ["a", "b"], ["v"], "seq", {"keep": -1})
    assert rows_of(out, "a", "b", "v", "keep") == [(1, None, 12, 7), (2, "x", 20, 8), (3, "y", 30, -1)]
    # A value set to null by the batch becomes null; it does not fall back to the old one.
    cleared = merge(base, spark.createDataFrame([(2, "x", None)], "a int, b string, v int"), ["a", "b"], ["v"])
    assert (2, "x", None, 8) in rows_of(cleared, "a", "b", "v", "keep")


def test_upsert_keeps_unlisted_columns_and_is_idempotent(lake, bars):
    stored = bars.withColumn("adj_factor", F.lit(2.0)).withColumn("is_st", F.lit(True))
    assert lake.upsert("daily", stored.filter("symbol = '000001.SZ'")) == 40
    changed = bars.withColumn("close", F.col("close") + 1)
    assert lake.upsert("daily", changed) == 80
    once = rows_of(as_double(lake.scan("daily")))
    lake.upsert("daily", changed)
    assert rows_of(as_double(lake.scan("daily"))) == once
    row = as_double(lake.scan("daily", symbol=["000001.SZ"])).orderBy("time").first()
    assert (row["close"], row["adj_factor"], row["is_st"], row["is_suspended"]) == (11.0, 2.0, True, False)
    other = lake.scan("daily", symbol=["000002.SH"]).first()
    assert (other["adj_factor"], other["is_st"]) == (None, False)


def test_upsert_of_nothing_and_of_repeated_keys(lake, bars):
    assert lake.upsert("daily", bars.limit(0)) == 0
    one = bars.limit(1)
    twice = one.withColumn("seq", F.lit(1)).unionByName(
        one.withColumn("seq", F.lit(2)).withColumn("close", F.lit(99.0)))
    assert lake.upsert("daily", twice, "seq") == 2
    assert [float(r["close"]) for r in lake.scan("daily").collect()] == [99.0]


def test_upsert_rewrites_only_touched_months(lake, bars):
    lake.upsert("daily", bars)
    import os

    def files(month):
        return set(os.listdir(f"{lake.path('daily')}/ym={month}"))

    january, february = files("2024-01"), files("2024-02")
    lake.upsert("daily", bars.filter(F.col("time") >= "2024-02-01"))
    assert files("2024-01") == january and files("2024-02") != february
    assert lake.scan("daily").count() == 80


def test_scans_prune_partitions(lake, bars):
    lake.upsert("daily", bars)
    scan = lake.scan("daily", "2024-02-01", "2024-02-05")
    assert scan.count() == 10
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ym" in plan and "PushedFilters: [IsNotNull(time)" in plan
    assert lake.load_panel(date(2024, 1, 1), date(2024, 2, 1)).count() == 62
    assert lake.load_returns(date(2024, 1, 1), date(2024, 1, 2), 1).count() == 18
    assert lake.load_ohlcv(symbols=["000002.SH"]).columns == [
        "time", "symbol", "open", "high", "low", "close", "volume"]
    assert lake.load_factors("2024-01-01").count() == 0  # typed empty result of a missing table
    found = lake.query("select count(*) as n from daily where symbol = '000001.SZ'").first()
    assert found["n"] == 40


def test_minute_index_and_stock_tables(lake, bars, spark):
    lake.upsert("minute", bars.drop("pct_change"))  # freq defaults to 1m
    lake.upsert("minute", bars.drop("pct_change").withColumn("freq", F.lit("5m")))
    assert lake.load_minute("1m").count() == 80
    assert lake.load_minute("5m", "2024-02-01", symbols=["000001.SZ"]).count() == 9
    lake.upsert("index_daily", bars.withColumn("name", F.lit("idx")))
    assert lake.load_index("000001.SZ", "2024-01-01", "2024-01-03").count() == 3
    stocks = spark.createDataFrame([("000001.SZ", "A")], "symbol string, name string")
    lake.upsert("stocks", stocks)
    lake.upsert("stocks", stocks.withColumn("name", F.lit("B")))
    assert [r["name"] for r in lake.load_stocks().collect()] == ["B"]


def test_signal_metadata_and_errors(lake, spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1), "a", "m", 1, 0.5)],
                                 "time timestamp, symbol string, strategy string, signal short, score double")
    lake.upsert("trading_signals", rows.withColumn("metadata", metadata_to_json()))
    assert lake.scan("trading_signals").first()["metadata"] == "{}"
    tagged = rows.withColumn("metadata", metadata_to_json(F.struct(F.lit("涨").alias("k"))))
    lake.upsert("trading_signals", tagged)
    assert lake.scan("trading_signals").first()["metadata"] == '{"k":"涨"}'
    texts = spark.range(1).select(join_errors(F.array(*map(F.lit, "abcdefg")), 5).alias("t"))
    assert texts.first()["t"] == "a; b; c; d; e"


def test_status_has_one_row_per_task(lake):
    record_sync(lake, "daily", date(2024, 1, 2))
    record_sync(lake, "daily", date(2024, 1, 3), [f"e{k}" for k in range(7)], 5)
    record_sync(lake, "factors", date(2024, 1, 3))
    rows = {r["data_type"]: r for r in lake.scan("sync_status").collect()}
    assert len(rows) == 2 and rows["daily"]["last_date"] == date(2024, 1, 3)
    assert (rows["daily"]["status"], rows["daily"]["error_msg"]) == ("error", "e0; e1; e2; e3; e4")
    assert (rows["factors"]["status"], rows["factors"]["error_msg"]) == ("ok", None)


def test_retention_and_catalog(lake, bars, spark):
    lake.create_tables("shelf")
    lake.upsert("daily", bars)
    lake.refresh_tables("shelf")
    assert spark.table("shelf.daily").count() == 80
    assert lake.drop_partitions_before("daily", "2024-02-10") == 1
    assert lake.scan("daily").agg(F.min("time")).first()[0] == datetime(2024, 2, 1)
    assert lake.drop_partitions_before("sync_status", "2024-02-10") == 0
    spark.sql("DROP DATABASE shelf CASCADE")


def test_landing_round_trip_and_scans(spark, bars, folder):
    vendor = to_vendor(bars)
    assert vendor.filter("trade_date = '20240131'").count() == 2
    for fmt in ("parquet", "json", "csv"):
        writer = vendor.write.option("header", True) if fmt == "csv" else vendor.write
        if fmt == "csv":  # csv is read by position, so it is written in landing order
            vendor.select("ts_code", "trade_date", "open", "high", "low", "close", "pct_chg", "vol",
                          "amount").write.option("header", True).csv(f"{folder}/csv")
        else:
            writer.format(fmt).save(f"{folder}/{fmt}")
        back = normalize_bars(scan_landing(spark, f"{folder}/{fmt}", fmt))
        assert rows_of(back) == rows_of(bars)
    odd = vendor.limit(2).withColumn("vol", F.lit(12.9))
    assert [r["volume"] for r in normalize_bars(odd).collect()] == [12, 12]
    assert [r["volume"] for r in normalize_bars(odd.withColumn("vol", F.lit(float("nan")))).collect()] == [None, None]
    days = [datetime(2024, 1, 5), datetime(2030, 1, 1)]
    assert scan_bars(bars, dates=days).count() == 2
    assert scan_bars(bars, symbols=["000001.SZ"], start="2024-01-30", end="2024-02-02").count() == 4


def test_update_bars_fills_gaps_only(lake, bars):
    calendar = bars.select("time").distinct()
    some = bars.filter(F.dayofmonth("time") != 5)
    assert update_bars(lake, to_vendor(some), calendar, date(2024, 2, 9), 60) == some.count()
    assert update_bars(lake, to_vendor(some), calendar, date(2024, 2, 9), 60) == 0
    changed = to_vendor(bars.withColumn("close", F.lit(1.0)))
    assert update_bars(lake, changed, calendar, date(2024, 2, 9), 60) == 4
    assert lake.scan("daily").filter("close = 1").count() == 4
    # The look-back bounds what is re-checked; force reloads all of it.
    assert update_bars(lake, changed, calendar, date(2024, 2, 9), 3, force=True) == 8
    assert lake.scan("sync_status").first()["last_date"] == date(2024, 2, 9)


def test_update_factors_equals_full_run(lake, make_bars):
    closes = [100 + (k * k) % 17 for k in range(150)]
    bars = make_bars({"a": [float(c) for c in closes], "b": [float(c + 1) for c in closes]})
    lake.upsert("daily", bars.filter(F.col("time") < "2024-05-01"))
    update_factors(lake, date(2024, 4, 30), lookback_days=200)
    lake.upsert("daily", bars)
    n = update_factors(lake, date(2024, 6, 1), lookback_days=60)
    full = compute_factors(bars.select("time", "symbol", "open", "high", "low", "close", "volume"))
    assert n == full.filter(F.col("time") >= "2024-05-01").count()
    assert rows_of(lake.load_factors()) == rows_of(full)
    assert update_factors(lake, date(2024, 6, 1), lookback_days=60) == 0
    one = update_factors(lake, date(2024, 6, 1), lookback_days=5, force=True, names=["ma20"])
    assert one > 0 and "ma20" not in DEFAULT_NAMES
    assert update_factors(lake, date(2023, 1, 1)) == 0


def test_update_factors_by_symbol(lake, make_bars):
    lake.upsert("daily", make_bars({"a": [float(k % 7 + 5) for k in range(40)]}))
    update_factors(lake, date(2024, 2, 9), 60, names=["limit_up"])
    lake.upsert("daily", make_bars({"b": [float(k % 7 + 5) for k in range(40)]}))
    assert update_factors(lake, date(2024, 2, 9), 60, names=["limit_up"]) == 0
    n = update_factors(lake, date(2024, 2, 9), 60, names=["limit_up"], grain=["time", "symbol"])
    assert n == 39


def test_exports(spark, bars, folder):
    gaps = bars.filter("not (symbol = '000002.SH' and dayofmonth(time) = 3)")
    exported = export.scan_export(gaps)
    assert exported.filter("adj_factor <> 1").count() == 0
    panel = export.dense_panel(exported)
    assert panel.count() == 80 and panel.filter("close is null").count() == 2
    arrays = {r["instrument"]: r for r in export.dense_panel(exported, as_arrays=True).collect()}
    assert arrays["sz000001"]["close"][:3] == [10.0, 11.0, 12.0]
    assert arrays["sh000002"]["close"][2] is None and len(arrays["sh000002"]["close"]) == 40
    export.write_calendar(exported, f"{folder}/cal")
    assert [r["value"] for r in spark.read.text(f"{folder}/cal").collect()][:2] == ["2024-01-01", "2024-01-02"]
    export.write_instruments(exported, f"{folder}/inst")
    lines = sorted(r["value"] for r in spark.read.text(f"{folder}/inst").collect())
    assert lines[0] == "SH000002\t2024-01-01\t2024-02-09"
    export.write_report(spark.createDataFrame([(1, "f", 0.5)], "lag int, factor_name string, ic_ir double"), f"{folder}/ic")
    assert spark.read.option("header", True).csv(f"{folder}/ic").first()["ic_ir"] == "0.5"


def test_rows_without_a_time_are_stored_and_merged(lake, bars):
    first = bars.limit(1).withColumns({"time": F.lit(None).cast("timestamp"), "symbol": F.lit("A")})
    lake.upsert("daily", first)
    lake.upsert("daily", first.withColumn("symbol", F.lit("B")).unionByName(bars.limit(2)))
    lake.upsert("daily", first.withColumn("close", F.lit(3.0)))
    rows = lake.scan("daily").filter("time is null").select("symbol", F.col("close").cast("double")).collect()
    assert sorted((r.symbol, r.close) for r in rows) == [("A", 3.0), ("B", 10.0)]
    assert lake.scan("daily").count() == 4


def test_null_partitions_merge_by_join_too(lake, bars, monkeypatch):
    from factorlake.sources import lake as module

    monkeypatch.setattr(module, "MAX_LISTED", 0)
    test_rows_without_a_time_are_stored_and_merged(lake, bars)


def test_repeated_keys_without_an_order_give_one_whole_row(spark):
    base = spark.createDataFrame([], "k int, v int, w int")
    batch = spark.createDataFrame([(1, 2, 5), (1, None, 7)], "k int, v int, w int")
    assert rows_of(merge(base, batch, ["k"], ["v", "w"]), "k", "v", "w") in ([(1, 2, 5)], [(1, None, 7)])


def test_a_failing_run_leaves_an_error_status(lake, bars):
    lake.upsert("daily", bars)
    update_factors(lake, date(2024, 2, 9), names=["limit_up"])
    with pytest.raises(ValueError, match="unknown"):
        update_factors(lake, date(2024, 2, 9), names=["nothing"], force=True)
    row = lake.scan("sync_status").first()
    assert row["status"] == "error" and row["last_date"] == date(2024, 2, 9) and "nothing" in row["error_msg"]


def test_a_day_that_cannot_be_read_does_not_stop_the_others(lake, bars):
    landed = to_vendor(bars).withColumn("close", F.col("close").cast("string"))
    bad = F.when((F.col("trade_date") == "20240205") & F.col("ts_code").startswith("000001"), "n/a").otherwise(F.col("close"))
    landed_bad = landed.withColumn("close", bad).withColumn("vol", F.when(
        F.col("trade_date") == "20240207", float("inf")).otherwise(F.col("vol")))
    extra = landed_bad.limit(1).withColumn("trade_date", F.lit("2024010x"))
    days = bars.select("time").distinct()
    with pytest.raises(PartialRun) as partial:
        update_bars(lake, landed_bad.unionByName(extra), days, date(2024, 2, 9), 60)
    assert [e.split(":")[0] for e in partial.value.errors] == ["20240205", "20240207", "unreadable day"]
    assert "(close)" in partial.value.errors[0] and "(vol)" in partial.value.errors[1]
    stored = {str(r.time.date()) for r in lake.scan("daily").select("time").distinct().collect()}
    assert stored == {str(r.time.date()) for r in days.collect()} - {"2024-02-05", "2024-02-07"}
    row = lake.scan("sync_status").first()
    assert row["status"] == "error" and row["error_msg"] == "; ".join(partial.value.errors)
    # The days are still gaps: once they can be read, they come in.
    assert update_bars(lake, landed, days, date(2024, 2, 9), 60) == 4
    assert lake.scan("daily").count() == bars.count() and lake.scan("sync_status").first()["status"] == "ok"


def test_a_plugin_that_fails_for_a_symbol_does_not_stop_the_others(lake, bars):
    def top(rows):
        if rows["symbol"].iloc[0].startswith("000001"):
            raise ValueError("no such stock")
        return rows["close"].rolling(2).max()

    lake.upsert("daily", bars)
    plugin = PandasFactor("top2", top, lookback=1)
    with pytest.raises(PartialRun, match="000001.SZ: top2: ValueError: no such stock"):
        update_factors(lake, date(2024, 2, 9), 60, names=["limit_up"], plugins=[plugin])
    found = lake.load_factors(names=["top2", "limit_up"]).groupBy("factor_name", "symbol").count().collect()
    assert {(r.factor_name, r.symbol) for r in found} == {
        ("limit_up", "000001.SZ"), ("limit_up", "000002.SH"), ("top2", "000002.SH")}
    row = lake.scan("sync_status").first()
    assert row["status"] == "error" and "000001.SZ" in row["error_msg"]
    with pytest.raises(Exception, match="no such stock"):
        plugin.compute(bars).collect()


def test_landing_scan_reads_only_the_days_of_the_run(lake, bars, folder):
    to_vendor(bars).write.parquet(f"{folder}/landing")
    landed = scan_landing(lake.spark, f"{folder}/landing")
    n = update_bars(lake, landed, bars.select("time").distinct(), date(2024, 2, 9), 7)
    assert n == 16 and lake.scan("daily").count() == 16


def test_stock_flags_missing_from_the_dimension_are_filled(lake, bars, spark):
    from factorlake.operators.joins import attach_dim

    lake.upsert("stocks", spark.createDataFrame([("000001.SZ", "A")], "symbol string, name string"))
    got = attach_dim(bars, lake.load_stocks(), "symbol", {"is_st": 0, "name": "?"})
    assert {(r.symbol, r["name"], r.is_st) for r in got.select("symbol", "name", "is_st").distinct().collect()} == {
        ("000001.SZ", "A", 0), ("000002.SH", "?", 0)}


def test_jobs_from_arguments(spark, bars, folder):
    from factorlake.jobs import run

    to_vendor(bars).write.parquet(f"{folder}/landing")
    root = ["--lake", f"{folder}/lake"]
    day = ["--as-of", "2024-02-09", "--lookback-days", "60"]
    assert run(spark, [*root, "bars", "--landing", f"{folder}/landing", *day]) == 80
    assert run(spark, [*root, "factors", "--names", "price_to_ma20", *day]) == 42
    assert run(spark, [*root, "ic", "--start", "2024-01-01", "--end", "2024-02-09", "--names", "price_to_ma20",
                       "--lags", "1", "5", "--report", f"{folder}/report"]) == 2
    assert spark.read.option("header", True).csv(f"{folder}/report").count() == 2
    status = {r["data_type"]: r["status"] for r in Lake(spark, f"{folder}/lake").scan("sync_status").collect()}
    assert status == {"daily": "ok", "factors": "ok"}
    with pytest.raises(ValueError, match="missing rsi14"):
        run(spark, [*root, "ic", "--start", "2024-01-01", "--end", "2024-02-09", "--names", "rsi14"])


def test_bucketed_panels_join_without_a_shuffle(spark, make_bars, folder):
    from factorlake.plans.backtest import signal_returns
    lake = Lake(spark, f"{folder}/lake")
    bars = make_bars({s: [float(9 + (k * n) % 5) for k in range(40)] for n, s in enumerate("abcd", 2)}).withColumn(
        "pct_change", F.lit(0.5))
    lake.upsert("daily", bars)
    lake.upsert("trading_signals", bars.select("time", "symbol", F.lit("s").alias("strategy"), F.lit(1).alias("signal"),
                                                F.lit(0.1).alias("score"), F.lit("{}").alias("metadata")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        daily, signals = (lake.publish_by_symbol("buckets_test", n, 4) for n in ("daily", "trading_signals"))
        returns = signal_returns(signals, daily, bound=40)
        joined = signals.select("time", "symbol", "signal").join(daily.select("time", "symbol", "close"), ["time", "symbol"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 160 and returns.count() == 156
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.sql("DROP DATABASE IF EXISTS buckets_test CASCADE")


def test_one_symbol_reads_few_row_groups(spark, make_bars, folder):
    """Files are sorted by symbol and have Bloom filters: other row groups are not read."""
    lake = Lake(spark, f"{folder}/lake")
    bars = make_bars({f"{k:06d}.SZ": [float(k % 7 + d) for d in range(20)] for k in range(0, 4_000, 2)})
    spark.conf.set("parquet.block.size", "65536")
    try:
        lake.upsert("daily", bars.repartition(1))
    finally:
        spark.conf.unset("parquet.block.size")

    def rows_read(df):
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))

    whole = rows_read(lake.scan("daily"))
    assert whole == 40_000
    assert rows_read(lake.scan("daily", symbol=["001000.SZ"])) < whole / 4
    # A symbol that lies between others and has no bar: told by the Bloom filters.
    assert rows_read(lake.scan("daily", symbol=["001001.SZ"])) == 0


def test_ic_of_days_is_completed_later(spark, make_bars, folder):
    """Runs in steps leave the rows of one run; settled days are not read again."""
    from datetime import date

    from factorlake.plans import research
    from factorlake.plans.factors import compute_factors
    names, lags = ["price_to_ma20", "limit_up"], (1, 5)
    bars = make_bars({s: [float(20 + (k * n) % 13) for k in range(90)] for n, s in enumerate("abcdef", 2)}).withColumn(
        "pct_change", (F.col("close") % 5) - 2)
    bars = bars.filter(~((F.col("symbol") == "c") & F.col("time").between("2024-02-10", "2024-02-28")))
    lakes = [Lake(spark, f"{folder}/{n}") for n in ("steps", "once")]
    for lake, days in zip(lakes, ([date(2024, 2, 14), date(2024, 2, 15), date(2024, 3, 30)], [date(2024, 3, 30)])):
        lake.upsert("daily", bars)
        lake.upsert("daily_factors", compute_factors(bars, names))
        for day in days:
            assert research.update_ic(lake, day, names, lags) > 0
    assert rows_of(lakes[0].scan("ic_daily")) == rows_of(lakes[1].scan("ic_daily"))
    scans, scan = [], lakes[0].scan
    lakes[0].scan = lambda name, *a, **kw: (scans.append((name, a)), scan(name, *a, **kw))[1]
    research.update_ic(lakes[0], date(2024, 3, 30), names, lags)
    # Only the last five rows of each symbol are open.
    assert min(a[0] for name, a in scans if name == "daily") >= date(2024, 3, 20)


def test_upsert_shuffles_rows_once_and_writes_them_once(spark, make_bars, folder):
    """A row is dealt out by partition and slot, merged where it lies, and written without a staging table."""
    lake = Lake(spark, folder)
    bars = make_bars({"a": [float(k) for k in range(1, 61)], "b": [float(k) for k in range(2, 62)]})
    assert lake.upsert("daily", bars) == 120
    assert lake.upsert("daily", bars.filter("symbol = 'a'").withColumn("close", F.lit(9.0))) == 60
    assert rows_of(as_double(lake.scan("daily")), "symbol", "close")[:2] == [("a", 9.0)] * 2
    assert lake.scan("daily").count() == 120
    assert not lake._exists(f"{folder}/_staging/daily")


def test_tasks_are_bounded_by_rows(spark):
    number = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    keys = [number, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        bound_tasks(spark, 36_000_000)
        one = int(spark.conf.get(number))
        bound_tasks(spark, 6 * 36_000_000)
        assert int(spark.conf.get(number)) == 6 * one
        assert 36_000_000 / one <= 50_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

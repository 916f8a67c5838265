"""What stored runs leave behind and what they do without: room on disk, memory and passes over the rows."""

import os
from datetime import date, datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from factorlake.operators.groups import LIMIT_KEY
from factorlake.plans import ic, research
from factorlake.plans.factors import compute_factors
from factorlake.session import STATE
from factorlake.sources.lake import Lake
from factorlake.sources.landing import normalize_bars, to_vendor
from factorlake.sources.upsert import merge
from factorlake.streaming import ingest, rollups

BASE = "k int, p string, v int, w double, kept int"


@pytest.mark.parametrize("told", [True, False])
@pytest.mark.parametrize("order", [None, ["a"], ["a", "b"]])
def test_merge_of_sorted_neighbours_equals_the_aggregation(spark, told, order):
    """Null keys, ties in the order, null and NaN values, columns that the batch has or has not."""
    base = spark.createDataFrame([(k, "x", k, float(k), 7) for k in (1, 2, 3)] + [(None, "y", 5, None, 8)], BASE)
    rows = [(k, p, v, w, v, a, b) for n, (k, p) in enumerate([(1, "x"), (2, "x"), (9, "y"), (None, "y"), (None, None)])
            for v, w, a, b in [(4, 1.5, 1, 2), (None, 2.5, 2, None), (6 + n, float("nan"), 2, 1), (3, None, 2, 1)]]
    batch = spark.createDataFrame(rows, f"{BASE}, a int, b int")
    batch = batch if told else batch.drop("kept")
    args = (base, batch, ["k", "p"], ["v", "w"], order, {"kept": 1})
    sorted_rows = merge(*args, spread=["p"])
    assert rows_of(sorted_rows.fillna(-1.0)) == rows_of(merge(*args).fillna(-1.0))
    plan = sorted_rows._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Sort [") == (2 if told else 1)


def left_over(spark):
    """Shuffle files in the session's local folders."""
    place = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {name for k in place.localDirsString() for _, _, names in os.walk(k) for name in names if name.endswith(".data")}


def test_an_upsert_leaves_no_shuffle_files_and_no_copy_of_its_batch(spark, make_bars, folder):
    bars = make_bars({s: [float(k + n) for k in range(80)] for n, s in enumerate("abc")}).withColumn("pct_change", F.lit(0.5))
    before, lake = left_over(spark), Lake(spark, folder)
    for _ in range(2):
        assert lake.upsert("daily", bars.repartition(3, "symbol")) == 240
    assert lake.scan("daily").count() == 240
    assert not os.listdir(f"{folder}/_batch")
    # One more shuffle, of the count: the files of the upserts are gone.
    assert len(left_over(spark) - before) <= 8


def test_factor_stream_without_stored_states_computes_none(spark, make_bars, folder, monkeypatch):
    """Late bars of a stream that has no states yet: no checkpoint and no means beside the factors asked for."""
    bars = make_bars({s: [float(50 + (k * n) % 13) for k in range(70)] for n, s in enumerate("ab", 3)}).withColumn(
        "pct_change", F.lit(0.5))
    late = F.dayofmonth("time") % 5 == 0
    for part in (~late, late):
        to_vendor(bars.filter(part)).coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    monkeypatch.setattr(ingest, "durable", lambda df: pytest.fail("checkpoint"))
    asked, carried = [], ingest.carried_factors
    monkeypatch.setattr(ingest, "carried_factors", lambda *a, **kw: (asked.append(carried(*a, **kw)), asked[-1])[1])
    lake, names = Lake(spark, f"{folder}/lake"), ["price_to_ma20", "limit_up"]
    source = normalize_bars(ingest.read_landing(spark, f"{folder}/landing", files_per_batch=1))
    ingest.stream_factors(source, lake, f"{folder}/cp", names).awaitTermination()
    assert rows_of(lake.scan("daily_factors")) == rows_of(compute_factors(bars, names))
    assert len(asked) == 2 and not {"closes", "month_end"} & {c for found in asked for c in found[0].columns}


def test_state_of_a_watermarked_rollup_is_on_disk_in_bounded_memory(spark, make_bars, folder):
    """Whatever store the session names, no row of a state is held on the heap."""
    bars = make_bars({s: [float(50 + (k * n) % 13) for k in range(40)] for n, s in enumerate("ab", 3)}).withColumn(
        "pct_change", F.lit(0.5))
    to_vendor(bars).coalesce(1).write.parquet(f"{folder}/landing")
    confs = {f"{STATE}{c}": None for c in ("providerClass", "rocksdb.boundedMemoryUsage", "rocksdb.maxMemoryUsageMB",
                                           "rocksdb.trackTotalNumberOfRows")}
    before = {c: spark.conf.get(c, None) for c in confs}
    spark.conf.set(f"{STATE}providerClass",
                   "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        source = normalize_bars(ingest.read_landing(spark, f"{folder}/landing"))
        lake = Lake(spark, f"{folder}/lake")
        rollups.stream_closed(source, lake, f"{folder}/cp", "week", timedelta(days=7)).awaitTermination()
        assert spark.conf.get(f"{STATE}rocksdb.boundedMemoryUsage") == "true"
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    kinds = {os.path.splitext(n)[1] for _, _, names in os.walk(f"{folder}/cp/close/state") for n in names}
    assert ".zip" in kinds and ".delta" not in kinds
    assert not os.listdir(f"{folder}/lake/_batch")


LONG = "time timestamp, symbol string, factor_name string, factor_value double"


def panel(spark):
    """Values without a bar, bars without a value, missing and infinite values, a day of one side only."""
    day = [datetime(2024, 1, d) for d in range(1, 12)]
    returns = [(day[d], s, None if (d + k) % 6 == 5 else float((d * 7 + k * 3) % 11 - 5))
               for d in range(8) for k, s in enumerate("abcdef") if (d * k) % 7 != 6]
    values = [(day[d], s, f, None if (d + k) % 9 == 8 else float("inf") if (d * k) % 13 == 12 else float((d + k * k * n) % 7))
              for d in (0, 1, 2, 4, 5, 6, 7, 9) for k, s in enumerate("abcdefg") for n, f in enumerate("fg", 1) if (d + k * n) % 5]
    return (spark.createDataFrame(values, LONG),
            spark.createDataFrame([*returns, (None, "a", 1.0), (day[3], None, 2.0)], "time timestamp, symbol string, pct_change double"))


def test_long_daily_ics_shuffle_each_side_by_day_once(spark):
    factors, returns = panel(spark)
    whole = ic.daily_ic(factors, returns, ["f", "g"], [1, 3], 100, 100, counts=True)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 3 and "Join" not in plan and "Aggregate" not in plan
    spark.conf.set(LIMIT_KEY, "3")
    try:
        split = rows_of(ic.daily_ic(factors, returns, ["f", "g"], [1, 3], counts=True))
    finally:
        spark.conf.unset(LIMIT_KEY)
    assert rows_of(whole) == split and len(split) == 20
    assert ic.daily_ic(factors, returns.filter("false"), ["f"], [1], 9, 9).isEmpty()
    assert ic.daily_ic(factors.filter("false"), returns, ["f"], [1], 9, 9).isEmpty()
    with pytest.raises(Exception, match="repeated key for factor g"):
        ic.daily_ic(factors.unionByName(factors.filter("factor_name = 'g'")), returns, ["f", "g"], [1], 9, 9).collect()


def test_long_daily_ics_of_factors_and_returns_from_one_table(spark):
    factors, returns = panel(spark)
    both = returns.filter("time is not null and symbol is not null")
    values = both.select("time", "symbol", F.lit("f").alias("factor_name"), F.col("pct_change").alias("factor_value"))
    apart = spark.createDataFrame(values.collect(), LONG)
    assert rows_of(ic.daily_ic(values, both, ["f"], [1], 9, 9)) == rows_of(ic.daily_ic(apart, both, ["f"], [1], 9, 9))


def test_ics_are_kept_up_to_date_without_a_join_of_the_panel(spark, make_bars, folder, monkeypatch):
    """Open stocks are counted where the ICs are made: only the small result meets the pending days."""
    bars = make_bars({s: [float(20 + (k * n) % 13) for k in range(70)] for n, s in enumerate("abcdef", 2)}).withColumn(
        "pct_change", (F.col("close") % 5) - 2)
    bars = bars.filter("symbol <> 'f' or time <= '2024-03-05'")
    lake, names = Lake(spark, folder), ["price_to_ma20", "limit_up"]
    lake.upsert("daily", bars)
    lake.upsert("daily_factors", compute_factors(bars, names))
    plans, upsert = [], lake.upsert
    monkeypatch.setattr(lake, "upsert", lambda name, df, *a, **kw: (
        plans.append(df._jdf.queryExecution().optimizedPlan().toString()), upsert(name, df, *a, **kw))[1])
    research.update_ic(lake, date(2024, 3, 1), names, (1, 5))
    research.update_ic(lake, date(2024, 3, 10), names, (1, 5))
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert len(plans) == 2 and joins and not any("symbol" in line for line in joins)
    pending = lake.scan("ic_daily").filter("n_open > 0").groupBy("lag").agg(F.min("time").cast("date").alias("d")).collect()
    assert {r["lag"]: str(r["d"]) for r in pending} == {1: "2024-03-05", 5: "2024-03-01"}

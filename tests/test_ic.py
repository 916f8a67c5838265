from datetime import datetime

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from factorlake.plans import ic

DAY = [datetime(2024, 1, d) for d in range(1, 29)]


@pytest.fixture(scope="module")
def returns(spark):
    rows = [(DAY[d], s, float((d * 7 + k * 3) % 11 - 5)) for d in range(10) for k, s in enumerate("abcdef")]
    return spark.createDataFrame(rows, "time timestamp, symbol string, pct_change double")


def long(spark, rows):
    return spark.createDataFrame(rows, "time timestamp, symbol string, factor_name string, factor_value double")


def daily(spark, returns, rows, lags=(1,)):
    return ic.daily_ic(long(spark, rows), returns, ["f"], list(lags))


def test_forward_return_is_by_row_and_drops_the_tail(returns):
    ahead = ic.forward_return(returns, 2)
    assert ahead.count() == 6 * 8
    first = ahead.filter("symbol = 'a'").orderBy("time").first()
    third = returns.filter("symbol = 'a'").orderBy("time").collect()[2]
    assert first["fwd_ret"] == third["pct_change"]


def test_ic_matches_pandas(spark, returns):
    rows = [(DAY[0], s, "f", v) for s, v in zip("abcdef", [1.0, 2.0, 2.0, 4.0, 0.5, 9.0])]
    pdf = ic.forward_return(returns, 1).filter(F.col("time") == DAY[0]).orderBy("symbol").toPandas()
    x = __import__("pandas").Series([1.0, 2.0, 2.0, 4.0, 0.5, 9.0])
    row = daily(spark, returns, rows).first()
    assert row["ic"] == pytest.approx(x.corr(pdf.fwd_ret), abs=1e-11)
    assert row["rank_ic"] == pytest.approx(x.rank().corr(pdf.fwd_ret.rank()), abs=1e-11)
    assert (row["n_stocks"], row["lag"], row["factor_name"]) == (6, 1, "f")


def test_constant_factor_and_single_stock_have_no_ic_and_no_day(spark, returns):
    rows = [(DAY[0], s, "f", 3.0) for s in "abcdef"] + [(DAY[1], "a", "f", 1.0)]
    got = daily(spark, returns, rows)
    assert [r["ic"] for r in got.collect()] == [None, None]
    assert [r["rank_ic"] for r in got.collect()] == [None, None]
    summary = ic.ic_summary(got).first()
    assert summary["n_days"] == 0 and summary["mean_ic"] is None and summary["ic_ir"] is None
    assert ic.null_ic_days(got).first()["n_days"] == 2


def test_non_finite_pairs_stay_out_before_ranking(spark, returns):
    good = [(DAY[0], s, "f", float(v)) for s, v in zip("abcd", [1, 2, 3, 4])]
    bad = [(DAY[0], "e", "f", float("nan")), (DAY[0], "f", "f", float("inf"))]
    assert rows_of(daily(spark, returns, good + bad)) == rows_of(daily(spark, returns, good))


def test_long_and_wide_agree_at_every_lag(spark, returns):
    rows = [(DAY[d], s, n, float((d + k * k * (i + 2)) % 7)) for d in range(10)
            for k, s in enumerate("abcdef") for i, n in enumerate(["f", "g"]) if (d + k + i) % 4]
    factors = long(spark, rows)
    wide = returns.join(
        factors.groupBy("time", "symbol").pivot("factor_name", ["f", "g"]).agg(F.first("factor_value")),
        ["time", "symbol"], "left")
    a = ic.daily_ic(factors, returns, ["f", "g"], [1, 3])
    b = ic.daily_ic_wide(wide, ["f", "g"], [1, 3])
    assert rows_of(a) == rows_of(b)
    assert a.count() == 2 * (9 + 7)


def test_split_days_equal_plain_days(spark, returns):
    from factorlake.operators.groups import LIMIT_KEY

    rows = [(DAY[d], s, "f", float((d * k) % 4)) for d in range(10) for k, s in enumerate("abcdef")]
    plain = rows_of(daily(spark, returns, rows, (1, 2)))
    spark.conf.set(LIMIT_KEY, "3")
    split = rows_of(daily(spark, returns, rows, (1, 2)))
    spark.conf.unset(LIMIT_KEY)
    assert split == plain


def test_ic_is_bounded_and_summary_is_consistent(spark, returns):
    rows = [(DAY[d], s, "f", float((d * 5 + k * k) % 7)) for d in range(10) for k, s in enumerate("abcdef")]
    got = daily(spark, returns, rows, (1, 2)).cache()
    assert got.filter("abs(ic) > 1 or abs(rank_ic) > 1").count() == 0
    summary = ic.ic_summary(got)
    pdf = got.filter("lag = 1").toPandas()
    row = summary.filter("lag = 1").first()
    assert row["mean_ic"] == pytest.approx(pdf.ic.mean())
    assert row["ic_ir"] == pytest.approx(pdf.ic.mean() / pdf.ic.std())
    assert row["t_stat"] == pytest.approx(row["ic_ir"] * len(pdf) ** 0.5)
    assert row["win_rate"] == pytest.approx((pdf.ic > 0).mean())
    decay = ic.ic_decay(summary, [1, 2, 9]).first()
    assert decay["lag_1"] == row["ic_ir"] and decay["lag_9"] is None
    rolled = ic.ic_rolling(got, 3).filter("lag = 1").orderBy("time").collect()
    assert [r["ic_ma"] is None for r in rolled[:4]] == [True, True, False, False]


def test_rank_factors_puts_missing_ratios_first(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (1, "b", None), (1, "c", 0.9)], "lag int, factor_name string, ic_ir double")
    assert [r["factor_name"] for r in ic.rank_factors(df).collect()] == ["b", "c", "a"]


def test_day_in_one_task_equals_split_day(spark):
    """Ties, gaps, a constant factor and a day of one stock: numpy per day gives what value counts give."""
    rows = [(f"2024-01-0{1 + k % 3}" if k else "2024-01-09", 0.1, None if k % 5 == 0 else float(k * 7 % 11),
             None if k % 4 == 1 else float(k % 6)) for k in range(80)]
    df = spark.createDataFrame(rows, "day string, flat double, x double, fwd_1 double").selectExpr(
        "to_timestamp(day) AS time", "flat", "x", "fwd_1")
    whole = ic._daily_ic(df, ["flat", "x"], [1], 80)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Window" not in plan
    assert rows_of(whole) == rows_of(ic._daily_ic_split(df, ["flat", "x"], [1]))
    assert whole.filter("factor_name = 'flat' and (ic is not null or rank_ic is not null)").isEmpty()

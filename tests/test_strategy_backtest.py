from datetime import datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from factorlake.operators.groups import LIMIT_KEY
from factorlake.plans import backtest as bt
from factorlake.plans import strategy as st

START = datetime(2024, 1, 1)


def wide(spark, rows):
    """Rows of (ma20, ma60, rsi14) on consecutive days of one symbol."""
    data = [(START + timedelta(days=k), "a", *map(float, r)) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, "time timestamp, symbol string, ma20 double, ma60 double, rsi14 double")


def signals(df):
    return [r["signal"] for r in df.orderBy("time").collect()]


@pytest.mark.parametrize("rsi,want", [(69, 1), (70, 0), (85, -1)])
def test_golden_cross_with_rsi(spark, rsi, want):
    assert signals(st.momentum_from_wide(wide(spark, [(1, 2, 50), (3, 2, rsi)]))) == [0, want]


def test_death_cross_first_row_and_touching_averages(spark):
    rows = [(3, 2, 50), (1, 2, 50), (2, 2, 50), (3, 2, 50), (3, 2, 81)]
    assert signals(st.momentum_from_wide(wide(spark, rows))) == [0, -1, 0, 1, -1]
    assert signals(st.momentum_from_wide(wide(spark, [(1, 2, 90)]))) == [-1]


def test_rows_with_gaps_are_dropped_before_the_lag(spark):
    rows = wide(spark, [(1, 2, 50), (float("nan"), 2, 50), (3, 2, 50)])
    assert signals(st.momentum_from_wide(rows)) == [0, 1]


def test_long_input_universe_and_missing_factor(spark):
    long = wide(spark, [(1, 2, 50), (3, 2, 50)]).unpivot(
        ["time", "symbol"], ["ma20", "ma60", "rsi14"], "factor_name", "factor_value")
    assert signals(st.run_strategy("momentum_v1", long)) == [0, 1]
    assert signals(st.run_strategy("momentum_v1", long, ["zzz"])) == []
    with pytest.raises(ValueError, match="missing rsi14"):
        st.momentum_from_wide(wide(spark, [(1, 2, 3)]).drop("rsi14"))
    with pytest.raises(ValueError, match="unknown strategy"):
        st.run_strategy("nope", long)


def returns(spark, series):
    data = [(g, START + timedelta(days=k), r) for g, rs in series.items() for k, r in enumerate(rs)]
    return spark.createDataFrame(data, "g string, time timestamp, strategy_ret double")


def test_metrics_edge_cases(spark):
    got = {r["g"]: r for r in bt.metrics(
        returns(spark, {"loss": [-0.5], "two": [0.1, -0.1], "flat": [0.0, 0.0]}), ["g"]).collect()}
    # A loss on the first day is no drawdown: the running peak starts with it.
    assert (got["loss"]["max_drawdown"], got["loss"]["calmar"]) == (0, 0)
    assert (got["loss"]["annualized_vol"], got["loss"]["sharpe"]) == (0, 0)
    assert got["two"]["max_drawdown"] == -0.1
    assert got["two"]["annualized_vol"] == pytest.approx(0.1 * 252 ** 0.5, abs=1e-4)
    assert got["two"]["annualized_return"] == pytest.approx(0.99 ** 126 - 1, abs=1e-4)
    assert got["flat"]["sharpe"] == 0
    with pytest.raises(ValueError, match="daily, weekly, monthly"):
        bt.metrics(returns(spark, {"a": [0.1]}), ["g"], "hourly")


def test_metrics_of_a_split_series(spark):
    rs = returns(spark, {"hot": [((k * 37) % 19 - 9) / 500 for k in range(300)], "b": [0.01, -0.02]})
    plain = rows_of(bt.metrics(rs, ["g"])), rows_of(bt.risk_analysis(rs, ["g"]))
    spark.conf.set(LIMIT_KEY, "30")
    split = rows_of(bt.metrics(rs, ["g"])), rows_of(bt.risk_analysis(rs, ["g"]))
    spark.conf.unset(LIMIT_KEY)
    assert split == plain


def test_signal_returns_use_the_signal_of_the_day_before(spark):
    s = spark.createDataFrame([(START + timedelta(days=k), "a", "m", v) for k, v in enumerate([1, -1, 0])],
                              "time timestamp, symbol string, strategy string, signal short")
    b = spark.createDataFrame([(START + timedelta(days=k), "a", v) for k, v in enumerate([5.0, 2.0, 3.0])],
                              "time timestamp, symbol string, pct_change double")
    got = [r["strategy_ret"] for r in bt.signal_returns(s, b).orderBy("time").collect()]
    assert got == pytest.approx([0.02, -0.03])


def test_topk_trades_next_day_with_costs_and_limits(spark):
    days = [START + timedelta(days=k) for k in range(6)]
    score = [("a", 5), ("a", 5), ("b", 5), ("b", 5), ("b", 5), ("b", 5)]
    scores = spark.createDataFrame([(d, s, float(v)) for d, (s, v) in zip(days, score)],
                                   "time timestamp, symbol string, score double")
    moves = {"a": [0, 1, 2, 10, 4, 1], "b": [0, 0, 0, 9.5, 3, 1]}
    bars = spark.createDataFrame([(d, s, float(m)) for s, ms in moves.items() for d, m in zip(days, ms)],
                                 "time timestamp, symbol string, pct_change double")
    got = {r["time"]: r for r in bt.topk_backtest(scores, bars, k=1).collect()}
    assert got[days[1]]["strategy_ret"] == pytest.approx(0.01 - 0.0005)  # bought for day 1
    assert got[days[2]]["strategy_ret"] == pytest.approx(0.02)
    # Day 3 switches from a to b, but both move by the limit: a is kept, b not bought.
    assert (got[days[3]]["n_held"], got[days[3]]["strategy_ret"]) == (1, pytest.approx(0.10))
    # Day 4 can be filled: b is bought and a sold, both at a cost.
    assert got[days[4]]["strategy_ret"] == pytest.approx(0.03 - 0.0005 - 0.0015)
    floor = bt.topk_backtest(scores, bars, k=1, notional=1000.0).filter(F.col("time") == days[1])
    assert floor.first()["cost"] == pytest.approx(5 / 1000)


def test_topk_positions_come_from_fills(spark):
    days = [START + timedelta(days=k) for k in range(7)]
    # Entry blocked on day 1 and wanted again on day 2; exit blocked on day 4, sold on day 5.
    moves, chosen = [0, 9.9, 1, 2, -9.9, 3, 1], [True, True, True, False, False, False, False]
    scores = spark.createDataFrame([(d, "a" if c else "z", 1.0) for d, c in zip(days, chosen)],
                                   "time timestamp, symbol string, score double")
    bars = spark.createDataFrame([(d, "a", float(m)) for d, m in zip(days, moves)],
                                 "time timestamp, symbol string, pct_change double")
    got = {r["time"]: (r["n_held"], round(r["gross_ret"], 9), r["cost"])
           for r in bt.topk_backtest(scores, bars, k=1).collect()}
    assert got == {days[2]: (1, 0.01, 0.0005), days[3]: (1, 0.02, 0.0), days[4]: (1, -0.099, 0.0),
                   days[5]: (0, 0.0, 0.0015)}
    # A blocked entry that is not wanted again opens nothing, so nothing is sold.
    once = scores.withColumn("symbol", F.when(F.col("time") == days[0], "a").otherwise("z"))
    assert bt.topk_backtest(once, bars, k=1).count() == 0


def test_waiting_exits_share_the_day(spark):
    days = [START + timedelta(days=k) for k in range(4)]
    scores = spark.createDataFrame([(d, s, 1.0) for d, s in zip(days, "abbb")],
                                   "time timestamp, symbol string, score double")
    moves = {"a": [0, 1, 10, 1], "b": [0, 0, 2, 1]}
    bars = spark.createDataFrame([(d, s, float(m)) for s, ms in moves.items() for d, m in zip(days, ms)],
                                 "time timestamp, symbol string, pct_change double")
    row = bt.topk_backtest(scores, bars, k=1).filter(F.col("time") == days[2]).first()
    assert (row["n_held"], row["gross_ret"]) == (2, pytest.approx((0.10 + 0.02) / 2))


def test_excess_rebalance_and_scores(spark):
    r = returns(spark, {"a": [0.02, 0.01]})
    index = spark.createDataFrame([(START, 1.0)], "time timestamp, pct_change double")
    got = bt.excess_return(r, index).orderBy("time").collect()
    assert [x["excess_ret"] for x in got] == pytest.approx([0.01, 0.01])
    s = spark.createDataFrame(
        [(START + timedelta(days=k), "000001.SZ", "m", 0, float("nan") if k == 6 else float(k), None) for k in range(9)],
        "time timestamp, symbol string, strategy string, signal short, score double, metadata string")
    assert [x["time"].day for x in bt.rebalance(s, "weekly").orderBy("time").collect()] == [7, 9]
    assert bt.rebalance(s, "monthly").count() == 1 and bt.rebalance(s, "daily").count() == 9
    with pytest.raises(ValueError):
        bt.rebalance(s, "yearly")
    scored = bt.score_panel(s).orderBy("datetime").collect()
    assert scored[6]["score"] == 0.0 and scored[0]["instrument"] == "SZ000001"


def test_compare_metrics(spark):
    a = bt.metrics(returns(spark, {"a": [0.1, 0.2]}), ["g"])
    b = bt.metrics(returns(spark, {"a": [0.1, -0.2]}), ["g"])
    rows = {r["metric"]: r for r in bt.compare_metrics(a, b, ["g"]).collect()}
    assert set(rows) == set(bt.METRICS)
    assert rows["max_drawdown"]["left_value"] == 0 and rows["max_drawdown"]["right_value"] == -0.2

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from factorlake.operators.groups import LIMIT_KEY
from factorlake.operators.reshape import duplicate_keys, to_long, to_wide
from factorlake.plans import factors
from factorlake.plans.factors import (
    DEFAULT_NAMES, Factor, PandasFactor, REGISTRY, compute_factors, compute_wide, register)


def values(df, name):
    return [r["factor_value"] for r in
            df.filter(F.col("factor_name") == name).orderBy("symbol", "time").collect()]


def test_rsi_of_a_rising_series_is_100_from_row_14(make_bars):
    rsi = compute_factors(make_bars({"a": [float(100 + k) for k in range(20)]}), ["rsi14"])
    assert values(rsi, "rsi14") == [100.0] * 7


def test_rsi_matches_the_recursive_definition(make_bars):
    random.seed(1)
    closes = [100.0]
    for _ in range(200):
        closes.append(round(closes[-1] + random.choice([-1, 0, 1, 2, -2]), 2))
    up = down = None
    want = []
    for k, c in enumerate(closes):
        d = 0.0 if k == 0 else c - closes[k - 1]
        u, v = max(d, 0.0), max(-d, 0.0)
        up = u if up is None else u / 14 + up * 13 / 14
        down = v if down is None else v / 14 + down * 13 / 14
        if k >= 13:
            want.append(100.0 if down == 0 else 100 - 100 / (1 + up / down))
    got = values(compute_factors(make_bars({"a": closes}), ["rsi14"]), "rsi14")
    assert got == pytest.approx(want, rel=1e-10)


@pytest.mark.parametrize("name,rows", [("price_to_ma20", 20), ("ma_cross", 60), ("macd_norm", 34),
                                       ("ma20", 20), ("ma60", 60), ("macd", 26), ("rsi14", 14)])
def test_first_value_comes_with_enough_rows(make_bars, name, rows):
    closes = [100.0 + (k * 7) % 11 for k in range(rows)]
    assert values(compute_factors(make_bars({"a": closes[:-1]}), [name]), name) == []
    assert len(values(compute_factors(make_bars({"a": closes}), [name]), name)) == 1


def test_limit_up_boundary_and_missing_prices(make_bars):
    bars = make_bars({"a": [100.0, 110.0, 120.99, 121.0, 100.0]})
    bars = bars.withColumn("high", F.when(F.col("close") != 121.0, F.col("close")))
    got = compute_factors(bars, ["limit_up"]).orderBy("time").select("factor_value").collect()
    # Day one has no previous close, day four no high; 110.00 is exactly the limit of 100.
    assert [r[0] for r in got] == [1.0, 0.0, 0.0]


def test_limit_price_rounds_half_up_to_the_cent(make_bars):
    # 92.05 * 1.1 = 101.255, which rounds up to 101.26.
    bars = make_bars({"a": [92.05, 101.255]}).withColumn("high", F.lit(101.255))
    assert values(compute_factors(bars, ["limit_up"]), "limit_up") == [0.0]


def test_unknown_factor_lists_the_available(make_bars):
    with pytest.raises(ValueError, match="nope.*available.*rsi14"):
        compute_factors(make_bars({"a": [1.0]}), ["nope"])


def test_symbols_do_not_mix_and_partitioning_does_not_matter(make_bars):
    random.seed(2)
    closes = {s: [100 + random.gauss(0, 3) for _ in range(80)] for s in "abc"}
    whole = compute_factors(make_bars(closes).repartition(7))
    single = [compute_factors(make_bars({s: c})) for s, c in closes.items()]
    assert rows_of(whole) == sorted(sum((rows_of(d) for d in single), []), key=repr)


def test_split_series_equal_plain_ones(spark, make_bars):
    random.seed(4)
    bars = make_bars({"hot": [100 + random.gauss(0, 3) for _ in range(5200)],
                      "b": [50 + random.gauss(0, 3) for _ in range(70)]})
    plain = rows_of(compute_factors(bars, DEFAULT_NAMES + ["macd"]))
    spark.conf.set(LIMIT_KEY, "2100")
    split = rows_of(compute_factors(bars, DEFAULT_NAMES + ["macd"]))
    spark.conf.unset(LIMIT_KEY)
    assert len(split) == len(plain)
    for a, b in zip(split, plain):
        assert a[0] == b[0] and a[2:] == b[2:]
        assert a[1] == pytest.approx(b[1], abs=1e-9)


def test_one_shuffle_and_no_python_for_all_factors(make_bars):
    plan = compute_factors(make_bars({"a": [1.0]}), bound=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "SinglePartition" not in plan


def test_reshape_round_trip_and_duplicates(make_bars):
    random.seed(6)
    bars = make_bars({"a": [100 + random.gauss(0, 3) for _ in range(90)]})
    wide = compute_wide(bars)
    back = to_wide(to_long(wide, DEFAULT_NAMES), DEFAULT_NAMES)
    kept = wide.filter(" or ".join(f"{n} is not null" for n in DEFAULT_NAMES))
    assert rows_of(back) == rows_of(kept)
    assert duplicate_keys(to_long(wide, DEFAULT_NAMES), ["time", "symbol", "factor_name"]).count() == 0


def test_plug_in_factor_shares_features(make_bars):
    register(Factor("gap60", ("ma60",), lambda: F.col("close") - F.col("ma60")))
    try:
        assert values(compute_factors(make_bars({"a": [5.0] * 60}), ["gap60"]), "gap60") == [0.0]
    finally:
        REGISTRY.pop("gap60")


@pytest.mark.parametrize("block,batch", [(3, 3), (7, 1_000_000), (50, 20), (4_096, 3)])
def test_pandas_factor_hands_rows_over(spark, make_bars, monkeypatch, block, batch):
    """The same values whatever a batch holds, in one task per symbol or in blocks of it."""
    random.seed(7)
    bars = make_bars({"a": [100 + random.gauss(0, 3) for _ in range(130)], "b": [1.0, 2.0, 3.0], "c": [5.0] * 9})
    seen = PandasFactor("peak5", lambda p: p["close"].rolling(5).max(), lookback=4)
    want = rows_of(seen.compute(bars, bound=130))
    assert len(want) == 126 + 5
    monkeypatch.setattr(factors, "BLOCK_ROWS", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert rows_of(seen.compute(bars, bound=130)) == want
        # An expanding plug-in looks back further than it says: its blocks are the same in both layouts.
        grown = PandasFactor("top", lambda p: p["close"].expanding().max(), lookback=2)
        in_order = rows_of(grown.compute(bars, bound=130))
        spark.conf.set(LIMIT_KEY, "40")
        assert rows_of(grown.compute(bars)) == in_order
        assert rows_of(seen.compute(bars)) == want
    finally:
        spark.conf.unset(LIMIT_KEY)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_keys_and_missing_factors_are_errors(spark):
    long = spark.createDataFrame([(1, "a", "ma20", 1.0), (1, "a", "ma20", 2.0)],
                                 "time int, symbol string, factor_name string, factor_value double")
    with pytest.raises(Exception, match="repeated key for factor ma20"):
        to_wide(long, ["ma20"]).collect()
    assert to_wide(long.limit(1), ["ma20", "ma60"]).collect()[0]["ma60"] is None
    from factorlake.plans.strategy import momentum_signals

    with pytest.raises(ValueError, match="missing ma60, rsi14; available: ma20"):
        momentum_signals(long)

"""The split layouts must equal the plain ones, on groups of very unequal size."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorlake.functions.ewm import Ewm, add_ewms
from factorlake.operators.groups import LIMIT_KEY, measure, oversized
from factorlake.operators.ordered import POS, Running, cumulative, over_series, positions
from factorlake.operators.ranks import exact_median, rank_corr, top_k, with_avg_ranks, with_masked_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """One hot symbol holds most rows; another has a single one."""
    random.seed(3)
    sizes = {"hot": 700, "b": 90, "c": 41, "d": 7, "one": 1}
    rows = [(s, t, random.gauss(0, 1), random.choice([0.0, 0.0, 1.0, 2.0]), float(random.randint(-9, 9)))
            for s, n in sizes.items() for t in range(n)]
    random.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, time int, x double, tied double, k double").repartition(5)


def test_measure_and_oversized(spark, skewed, tiny_limit):
    assert measure(skewed, ["symbol"]) == (839, 700)
    assert oversized(skewed, ["symbol"]).largest == 700
    assert oversized(skewed, ["symbol"], bound=40) is None
    assert oversized(skewed, ["symbol"], bound=41) is not None  # a useless bound is measured


def test_positions(skewed, tiny_limit):
    got = positions(skewed, ["symbol"], "time")
    assert got.filter(F.col(POS) != F.col("time")).count() == 0
    assert got.count() == 839


def test_over_series_split_equals_plain(spark, skewed, tiny_limit):
    def add(df, s):
        return df.select("*", s.sma("x", 20).alias("ma"), s.prev("x", 3).alias("p3"),
                         s.ahead("x", 15).alias("a15"), s.diff("x").alias("d"))

    options = dict(by=["symbol"], order="time", before=19, after=15)
    split = over_series(skewed, add, **options)
    plain = over_series(skewed, add, **options, bound=1)
    assert split.columns == plain.columns
    assert rows_of(split) == rows_of(plain)


def test_blocks_narrower_than_the_look_back(spark, skewed, tiny_limit):
    def add(df, s):
        return df.withColumn("ma", s.sma("x", 100))

    options = dict(by=["symbol"], order="time", before=99)
    assert rows_of(over_series(skewed, add, **options)) == rows_of(
        over_series(skewed, add, **options, bound=1))


def test_split_windows_hold_no_large_group(spark, skewed, tiny_limit):
    seen = {}

    def add(df, s):
        seen["by"] = s.by
        n = F.count(F.lit(1)).over(Window.partitionBy(*s.by))
        return df.withColumn("n", n)

    largest = over_series(skewed, add, by=["symbol"], order="time", before=5, after=5).agg(
        F.max("n")).first()[0]
    assert seen["by"] == ("symbol", "__block")
    assert largest <= 40 + 5 + 5


def test_cumulative_split_equals_plain(skewed, tiny_limit):
    steps = [Running("total", "sum", F.col("x")), Running("peak", "max", F.col("total")),
             Running("growth", "product", 1 + F.col("x") / 100)]
    assert rows_of(cumulative(skewed, ["symbol"], "time", steps)) == rows_of(
        cumulative(skewed, ["symbol"], "time", steps, bound=1))


@pytest.mark.parametrize("source", ["x", "tied", "k"])
def test_ranks_split_equals_plain(skewed, tiny_limit, source):
    split = with_avg_ranks(skewed, ["symbol"], {"r": source})
    plain = with_avg_ranks(skewed, ["symbol"], {"r": source}, bound=1)
    assert rows_of(split, "symbol", "time", "r") == rows_of(plain, "symbol", "time", "r")


def test_ranks_match_pandas_and_skip_nulls(skewed, tiny_limit):
    gaps = skewed.withColumn("v", F.when(F.col("k") != 3, F.col("tied")))
    pdf = gaps.toPandas()
    pdf["want"] = pdf.groupby("symbol")["v"].rank(method="average")
    for bound in (None, 1):
        got = with_avg_ranks(gaps, ["symbol"], {"r": "v"}, bound).toPandas()
        merged = got.merge(pdf[["symbol", "time", "want"]], on=["symbol", "time"])
        assert len(merged) == 839
        assert ((merged.r == merged.want) | (merged.r.isna() & merged.want.isna())).all()


def test_masked_ranks_equal_ranks_of_the_filtered_rows(skewed, tiny_limit):
    skewed = skewed.withColumn("tied", F.when(F.col("k") < 7, F.col("tied")))
    mask = F.col("k") > -3
    want = rows_of(with_avg_ranks(skewed.filter(mask), ["symbol"], {"r": "tied"}, bound=1),
                   "symbol", "time", "r")
    for bound in (None, 1):
        got = with_masked_ranks(skewed, ["symbol"], "tied", {"r": mask}, bound).filter(mask)
        assert rows_of(got, "symbol", "time", "r") == want


def test_rank_corr_split_equals_plain_and_pandas(skewed, tiny_limit):
    split = rank_corr(skewed, ["symbol"], "x", "tied")
    assert rows_of(split) == rows_of(rank_corr(skewed, ["symbol"], "x", "tied", bound=1))
    pdf = skewed.toPandas()
    hot = pdf[pdf.symbol == "hot"]
    row = split.filter("symbol = 'hot'").first()
    assert row["ic"] == pytest.approx(hot.x.corr(hot.tied), abs=1e-11)
    assert row["rank_ic"] == pytest.approx(hot.x.rank().corr(hot.tied.rank()), abs=1e-11)
    assert split.filter("symbol = 'one'").first()["ic"] is None


def test_exact_median_split_and_plain(skewed, tiny_limit):
    want = {k: pytest.approx(v) for k, v in skewed.toPandas().groupby("symbol").x.median().items()}
    for bound in (None, 1):
        got = {r["symbol"]: r["median"] for r in exact_median(skewed, ["symbol"], "x", bound).collect()}
        assert got == want


def test_running_last_split_equals_plain(skewed, tiny_limit):
    step = Running("last", "last", F.when(F.col("k") > 5, F.col("x")))
    split = rows_of(cumulative(skewed, ["symbol"], "time", [step]), "symbol", "time", "last")
    assert split == rows_of(cumulative(skewed, ["symbol"], "time", [step], 1), "symbol", "time", "last")
    assert any(v is not None for _, _, v in split)


def test_top_k_limits_before_the_shuffle(skewed):
    top = top_k(skewed, ["symbol"], "x", 3, tie="time")
    assert top.count() == 3 * 4 + 1
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("alpha,seed,least", [(1 / 14, 0, 14), (2 / 13, 0, 12), (2 / 27, 0, 26), (0.2, 25, 9),
                                              (2 / 121, 0, 120), (0.8, 0, 1), (0.9, 3, 1), (1.0, 0, 1)])
def test_ewm_matches_recursion(spark, alpha, seed, least):
    random.seed(5)
    values = [100 + random.gauss(0, 5) for _ in range(2600)]
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(values)], "symbol string, time int, v double")
    spec = Ewm("y", "v", alpha, seed, least)

    def add(d, s):
        return add_ewms(d, s, [spec])

    want, y = [], None
    for k, v in enumerate(values):
        if k >= seed:
            y = v if y is None else alpha * v + (1 - alpha) * y
        want.append(y if k >= seed + least - 1 else None)
    for limit in ("2000000", "700"):  # the second cuts the series into blocks
        spark.conf.set(LIMIT_KEY, limit)
        got = over_series(df, add, by=["symbol"], order="time", before=spec.memory).orderBy("time").collect()
        spark.conf.unset(LIMIT_KEY)
        for row, w in zip(got, want):
            assert (row["y"] is None) == (w is None)
            if w is not None:
                assert row["y"] == pytest.approx(w, rel=1e-11)


def test_fast_and_slow_means_in_one_call(spark):
    df = spark.range(1500).select(F.lit("s").alias("symbol"), F.col("id").alias("time"),
                                  (F.col("id") % 17).cast("double").alias("v"))
    specs = [Ewm("fast", "v", 0.95), Ewm("slow", "v", 0.02)]
    got = over_series(df, lambda d, s: add_ewms(d, s, specs), by=["symbol"], order="time").orderBy("time")
    fast = slow = 0.0
    for k, row in enumerate(got.collect()):
        fast, slow = (row["v"], row["v"]) if k == 0 else (
            0.95 * row["v"] + 0.05 * fast, 0.02 * row["v"] + 0.98 * slow)
        assert (row["fast"], row["slow"]) == (pytest.approx(fast, rel=1e-11), pytest.approx(slow, rel=1e-11))


@pytest.mark.parametrize("alpha", [0.0, -0.1, 1.5])
def test_ewm_refuses_impossible_weights(alpha):
    with pytest.raises(ValueError):
        Ewm("y", "v", alpha)


@pytest.mark.parametrize("alpha", [1e-4, 0.02, 1 / 14, 0.5, 1.0])
def test_ewm_over_five_ranges_equals_pandas(spark, make_bars, alpha):
    """Affine maps of ranges, composed: weights that never forget and weights that forget at once."""
    import pandas as pd

    from factorlake.functions.ewm import Ewm, range_ewms

    series = {"a": [100 + (k * 37) % 23 + k / 9 for k in range(230)], "b": [5.0, 7.0], "c": [1.0] * 45}
    spark.conf.set(LIMIT_KEY, "110")  # ranges of 55 rows
    try:
        got = range_ewms(make_bars(series), ["symbol"], "time", [Ewm("y", "close", alpha), Ewm("z", "close", alpha, 60, 3)], 277)
        rows = got.orderBy("symbol", "time").collect()
    finally:
        spark.conf.unset(LIMIT_KEY)
    for symbol, closes in series.items():
        mine = [r for r in rows if r["symbol"] == symbol]
        want = pd.Series(closes).ewm(alpha=alpha, adjust=False).mean()
        assert [r["y"] for r in mine] == pytest.approx(want.tolist(), rel=1e-12)
        late = pd.Series(closes[60:]).ewm(alpha=alpha, adjust=False).mean().tolist()
        assert [r["z"] for r in mine[:62]] == [None] * len(mine[:62])
        assert [r["z"] for r in mine[62:]] == pytest.approx(late[2:], rel=1e-12)

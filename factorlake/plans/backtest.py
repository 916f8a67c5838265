"""Returns, equity curves and risk figures, one row per group rather than per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.functions.missing import nan_to
from factorlake.functions.scalars import to_naive_day, to_prefix_code
from factorlake.operators.joins import join_panel
from factorlake.operators.ordered import Running, cumulative, over_series
from factorlake.operators.ranks import top_k

# Periods per year, digits of reported figures, trading days for risk analysis.
PERIODS = {"daily": 252, "weekly": 52, "monthly": 12}
DIGITS = 4
RISK_DAYS = 238
METRICS = ["annualized_return", "annualized_vol", "sharpe", "max_drawdown", "calmar"]
REBALANCE = {"weekly": "week", "monthly": "month"}


def signal_returns(signals: DataFrame, bars: DataFrame | None = None,
                   bound: int | None = None) -> DataFrame:
    """Yesterday's signal times today's change, per strategy and symbol.

    Without ``bars`` the signals carry ``pct_change`` themselves, which saves the join.
    """
    joined = signals.select("time", "symbol", "strategy", "signal",
                            *(["pct_change"] if bars is None else []))
    if bars is not None:
        joined = join_panel(joined, bars.select("time", "symbol", "pct_change"))
    lagged = over_series(joined, lambda df, s: df.withColumn("held", s.prev("signal")),
                         by=["strategy", "symbol"], order="time", before=1, bound=bound)
    ret = F.col("held") * F.col("pct_change") / 100
    return lagged.select("time", "symbol", "strategy", ret.alias("strategy_ret")).na.drop(
        subset=["strategy_ret"])


def equity_curve(returns: DataFrame, by: list[str], ret: str = "strategy_ret",
                 order: str = "time", bound: int | None = None) -> DataFrame:
    """Add ``equity`` (compounded), its running ``peak`` and the ``drawdown`` from it."""
    steps = [Running("equity", "product", 1 + F.col(ret)), Running("peak", "max", F.col("equity"))]
    curve = cumulative(returns, by, order, steps, bound)
    return curve.withColumn("drawdown",
                            F.try_divide(F.col("equity") - F.col("peak"), F.col("peak")))


def _or_zero(ratio: Column) -> Column:
    return F.coalesce(ratio, F.lit(0.0))


def metrics(returns: DataFrame, by: list[str], freq: str = "daily", ret: str = "strategy_ret",
            order: str = "time", bound: int | None = None) -> DataFrame:
    """Annualised return and volatility, Sharpe, maximum drawdown and Calmar per group."""
    if freq not in PERIODS:
        raise ValueError(f"unknown freq {freq!r}; one of {', '.join(PERIODS)}")
    per_year = PERIODS[freq]
    stats = equity_curve(returns, by, ret, order, bound).groupBy(*by).agg(
        F.product(1 + F.col(ret)).alias("growth"),
        F.count(F.lit(1)).alias("n"),
        F.stddev_pop(ret).alias("vol"),
        F.min("drawdown").alias("dd"),
    )
    year = F.pow("growth", F.lit(float(per_year)) / F.col("n")) - 1
    vol = F.col("vol") * F.sqrt(F.lit(float(per_year)))
    figures = {
        "annualized_return": year,
        "annualized_vol": vol,
        "sharpe": _or_zero(F.try_divide(year, vol)),
        "max_drawdown": F.col("dd"),
        "calmar": _or_zero(F.try_divide(year, F.abs("dd"))),
    }
    return stats.select(*by, *[F.round(c, DIGITS).alias(n) for n, c in figures.items()])


def compare_metrics(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Two metric tables side by side: one row per group and metric."""
    a = left.unpivot(by, METRICS, "metric", "left_value")
    b = right.unpivot(by, METRICS, "metric", "right_value")
    return a.join(b, [*by, "metric"], "full_outer")


def risk_analysis(returns: DataFrame, by: list[str], ret: str = "strategy_ret",
                  order: str = "time", bound: int | None = None) -> DataFrame:
    """Additive figures: mean, deviation, annualised return, information ratio, drawdown."""
    steps = [Running("total", "sum", F.col(ret)), Running("peak", "max", F.col("total"))]
    curve = cumulative(returns, by, order, steps, bound)
    mean, std = F.avg(ret), F.stddev_samp(ret)
    return curve.groupBy(*by).agg(
        mean.alias("mean"),
        std.alias("std"),
        (mean * RISK_DAYS).alias("annualized_return"),
        (F.try_divide(mean, std) * F.sqrt(F.lit(float(RISK_DAYS)))).alias("information_ratio"),
        F.min(F.col("total") - F.col("peak")).alias("max_drawdown"),
    )


def score_panel(signals: DataFrame) -> DataFrame:
    """Scores for a ranking backtest: naive day, prefixed instrument code, no missing score."""
    return signals.select(
        to_naive_day("time").alias("datetime"),
        to_prefix_code("symbol").alias("instrument"),
        nan_to("score", 0.0).alias("score"),
    )


def topk_backtest(scores: DataFrame, bars: DataFrame, k: int = 1, open_cost: float = 0.0005,
                  close_cost: float = 0.0015, min_cost: float = 5.0, limit: float = 0.095,
                  notional: float = 1_000_000.0, bound: int | None = None) -> DataFrame:
    """Hold each day's top ``k`` on the next bar, in equal slots, after costs.

    A symbol chosen at one bar is wanted on its next bar. On a bar that moves by ``limit`` or more
    nothing is filled, so the position of a symbol is what was wanted on its last bar that
    could be filled. It is bought and sold where the position changes; a blocked entry
    opens nothing and costs nothing, a blocked exit is sold, at a cost, on the first bar that
    can be filled. Costs are a share of the slot with a floor of ``min_cost`` per trade. While
    exits wait, more than ``k`` names may be held; the day's gain is then shared among them.
    Days without a position or trade have no row.
    """
    chosen = top_k(scores.select("time", "symbol", "score"), ["time"], "score", k)
    marked = bars.select("time", "symbol", "pct_change").join(
        chosen.select("time", "symbol", F.lit(True).alias("chosen")), ["time", "symbol"], "left")

    def wanted(df, series):
        return df.withColumn("want", F.coalesce(series.prev("chosen"), F.lit(False)))

    def before(df, series):
        return df.withColumn("had", F.coalesce(series.prev("held"), F.lit(False)))

    rows = over_series(marked, wanted, by=["symbol"], order="time", before=1, bound=bound)
    blocked = F.coalesce(F.abs("pct_change") >= limit * 100, F.lit(False))
    filled = Running("held", "last", F.when(~blocked, F.col("want")))
    rows = cumulative(rows, ["symbol"], "time", [filled], bound).withColumn(
        "held", F.coalesce("held", F.lit(False)))
    rows = over_series(rows, before, by=["symbol"], order="time", before=1, bound=bound)
    held, had = F.col("held"), F.col("had")
    slot = notional / k
    buy_rate, sell_rate = max(open_cost, min_cost / slot), max(close_cost, min_cost / slot)
    gain = F.when(held, F.coalesce(F.col("pct_change"), F.lit(0.0)) / 100).otherwise(0.0)
    cost = F.when(held & ~had, buy_rate).when(had & ~held, sell_rate).otherwise(0.0)
    return (
        rows.filter(held | had)
        .groupBy("time")
        .agg(
            F.count_if(held).alias("n_held"),
            (F.sum(gain) / F.greatest(F.lit(k), F.count_if(held))).alias("gross_ret"),
            (F.sum(cost) / k).alias("cost"),
        )
        .withColumn("strategy_ret", F.col("gross_ret") - F.col("cost"))
    )


def excess_return(returns: DataFrame, index: DataFrame, ret: str = "strategy_ret") -> DataFrame:
    """Add the benchmark return of the day and the excess over it (no benchmark counts as 0)."""
    bench = index.select("time", (F.col("pct_change") / 100).alias("bench_ret"))
    return (
        returns.join(bench, "time", "left")
        .withColumn("bench_ret", F.coalesce("bench_ret", F.lit(0.0)))
        .withColumn("excess_ret", F.col(ret) - F.col("bench_ret"))
    )


def rebalance(signals: DataFrame, freq: str = "weekly") -> DataFrame:
    """Keep the last signal of each symbol per week or month; daily keeps every row."""
    if freq == "daily":
        return signals
    if freq not in REBALANCE:
        raise ValueError(f"unknown freq {freq!r}; one of daily, {', '.join(REBALANCE)}")
    last = [F.max_by(c, "time").alias(c) for c in ("signal", "score", "metadata")]
    return (
        signals.groupBy("strategy", "symbol", F.date_trunc(REBALANCE[freq], "time").alias("__b"))
        .agg(F.max("time").alias("time"), *last)
        .select("time", "symbol", "strategy", "signal", "score", "metadata")
    )

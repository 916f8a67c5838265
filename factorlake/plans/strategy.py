"""Strategies: long factor tables in, one signal table out."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.functions.missing import drop_any_nan
from factorlake.operators.columns import in_universe
from factorlake.operators.ordered import over_series
from factorlake.operators.reshape import require, require_factors, to_wide

SIGNAL_COLUMNS = ["time", "symbol", "strategy", "signal", "score", "metadata"]
MOMENTUM = "momentum_v1"
MOMENTUM_FACTORS = ["ma20", "ma60", "rsi14"]


class Strategy(Protocol):
    """Maps a long factor table and a universe to rows of ``SIGNAL_COLUMNS``."""

    def __call__(self, factors: DataFrame, universe=None) -> DataFrame: ...


def momentum_from_wide(wide: DataFrame, rsi_overbought: float = 70.0, rsi_sell: float = 80.0,
                       bound: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Golden cross below the RSI cap buys; a death cross, or a hot RSI, sells.

    ``keep`` names further columns of ``wide`` to carry along.
    """
    require(wide, MOMENTUM_FACTORS)
    known = drop_any_nan(wide, MOMENTUM_FACTORS)
    lagged = over_series(
        known,
        lambda df, s: df.select("*", s.prev("ma20").alias("ma20_prev"),
                                s.prev("ma60").alias("ma60_prev")),
        by=["symbol"], order="time", before=1, bound=bound,
    )
    short, long, rsi = F.col("ma20"), F.col("ma60"), F.col("rsi14")
    golden = (short > long) & (F.col("ma20_prev") <= F.col("ma60_prev"))
    death = (short < long) & (F.col("ma20_prev") >= F.col("ma60_prev"))
    signal = (
        F.when(golden & (rsi < rsi_overbought), 1)
        .when(death | (rsi > rsi_sell), -1)
        .otherwise(0)
    )
    return lagged.select(
        "time", "symbol", F.lit(MOMENTUM).alias("strategy"),
        signal.cast("short").alias("signal"), (short - long).alias("score"),
        F.lit(None).cast("string").alias("metadata"), *keep,
    )


def momentum_signals(factors: DataFrame, universe=None, rsi_overbought: float = 70.0,
                     rsi_sell: float = 80.0, bound: int | None = None) -> DataFrame:
    """Momentum signals from a long factor table; an empty universe means every symbol.

    A factor of which the table has no row at all is an error.
    """
    require_factors(factors, MOMENTUM_FACTORS)
    wide = to_wide(in_universe(factors, "symbol", universe), MOMENTUM_FACTORS)
    return momentum_from_wide(wide, rsi_overbought, rsi_sell, bound)


STRATEGIES: dict[str, Strategy] = {MOMENTUM: momentum_signals}


def run_strategy(name: str, factors: DataFrame, universe=None, **params) -> DataFrame:
    """Run a registered strategy with plain keyword parameters."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}; available: {', '.join(STRATEGIES)}")
    return STRATEGIES[name](factors, universe, **params).select(*SIGNAL_COLUMNS)


def signal_counts(signals: DataFrame) -> DataFrame:
    return signals.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_signals"),
        F.count_if(F.col("signal") == 1).alias("n_buy"),
        F.count_if(F.col("signal") == -1).alias("n_sell"),
        F.count_if(F.col("signal") != 0).alias("n_active"),
    )

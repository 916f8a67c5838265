"""The limit-up study: cleaned panel, next-day returns, group and correlation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.functions.stats import avg_if
from factorlake.operators.columns import clean_universe
from factorlake.operators.joins import attach_dim
from factorlake.operators.ordered import over_series
from factorlake.operators.ranks import rank_corr
from factorlake.plans.factors import hits_limit, limit_price


def study_panel(bars: DataFrame, stocks: DataFrame | None, bound: int | None = None) -> DataFrame:
    """Cleaned rows with ``limit_up_price`` and ``is_limit_up``.

    The previous close is taken before the filter: it is the last bar, not the last kept row.
    """
    panel = over_series(bars, lambda df, s: df.withColumn("prev_close", s.prev("close")),
                        by=["symbol"], order="time", before=1, bound=bound)
    return clean_universe(attach_dim(panel, stocks, "symbol", {"is_st": 0})).withColumns({
        "limit_up_price": limit_price("prev_close").cast("double"),
        "is_limit_up": hits_limit().cast("byte"),
    })


def with_next_return(panel: DataFrame, bound: int | None = None) -> DataFrame:
    """Add ``next_ret``, the change at the next kept row; rows without one are dropped."""
    ahead = over_series(panel, lambda df, s: df.withColumn("next_ret", s.ahead("pct_change")),
                        by=["symbol"], order="time", after=1, bound=bound)
    return ahead.na.drop(subset=["next_ret"])


def study_ic(panel: DataFrame, bound: int | None = None) -> DataFrame:
    """Daily ic and rank_ic of the limit-up flag, complete days only."""
    pairs = panel.select("time", F.col("is_limit_up").cast("double").alias("flag"), "next_ret")
    return rank_corr(pairs, ["time"], "flag", "next_ret", bound).na.drop()


def cond_means(panel: DataFrame) -> DataFrame:
    """Counts and mean next return after a limit-up day and after other days."""
    hit = F.col("is_limit_up") == 1
    return panel.agg(
        F.count_if(hit).alias("n_limit_up"),
        F.count_if(~hit).alias("n_other"),
        F.avg(hit.cast("double")).alias("limit_up_share"),
        avg_if("next_ret", hit).alias("mean_after_limit_up"),
        avg_if("next_ret", ~hit).alias("mean_after_other"),
    )

"""Information coefficients: factor values against later returns, day by day.

All lags and all factors go through one plan and one shuffle by day.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.functions.missing import finite
from factorlake.functions.stats import CORR_DIGITS, safe_corr, win_rate
from factorlake.operators.groups import oversized, row_limit
from factorlake.operators.joins import join_panel
from factorlake.operators.ordered import Series, over_series
from factorlake.operators.ranks import with_masked_ranks
from factorlake.operators.reshape import ID, to_wide
from factorlake.session import durable

# Most rows of a day that one task takes as a whole.
DAY_ROWS = 1_000_000


def _lag_columns(lags: list[int]) -> list[str]:
    return [f"fwd_{n}" for n in lags]


def with_forward_returns(returns: DataFrame, lags: list[int], ret: str = "pct_change",
                         bound: int | None = None) -> DataFrame:
    """Add ``fwd_<lag>``: the return ``lag`` rows ahead of the same symbol."""

    def add(df: DataFrame, series: Series) -> DataFrame:
        return df.select("*", *[series.ahead(ret, n).alias(c)
                                for n, c in zip(lags, _lag_columns(lags))])

    return over_series(returns, add, by=["symbol"], order="time", after=max(lags), bound=bound)


def forward_return(returns: DataFrame, lag: int, bound: int | None = None) -> DataFrame:
    """(time, symbol, fwd_ret), without the rows that have no bar ``lag`` rows ahead."""
    ahead = with_forward_returns(returns.select(*ID, "pct_change"), [lag], bound=bound)
    return ahead.select(*ID, F.col(f"fwd_{lag}").alias("fwd_ret")).na.drop(subset=["fwd_ret"])


def daily_ic_wide(panel: DataFrame, names: list[str], lags: list[int],
                  symbol_bound: int | None = None, day_bound: int | None = None) -> DataFrame:
    """Daily ic, rank_ic and n_stocks per (lag, factor, day) from factor columns and
    ``pct_change`` in one row.

    Forward returns use the partitioning the factors were computed in.
    """
    ahead = with_forward_returns(panel, lags, bound=symbol_bound)
    return _daily_ic(ahead.select("time", *names, *_lag_columns(lags)), names, lags, day_bound)


def _daily_ic_split(rows: DataFrame, names: list[str], lags: list[int], counts: bool = False) -> DataFrame:
    """Daily ICs where a day is too many rows for one task: ranks come from value counts.

    A rank is taken among the rows that have both a value and a return, which is a masked
    count over one ordering: returns are ordered once per lag for all factors, values once
    per factor for all lags. Rows are expanded by factor only after the returns are ranked, and
    by lag only once they are aggregated.
    """
    returns = _lag_columns(lags)
    rows = durable(rows)
    for y in returns:
        masks = {f"ry_{y}_{k}": F.col(x).isNotNull() for k, x in enumerate(names)}
        rows = with_masked_ranks(rows, ["time"], y, masks)
    # A number stands for the factor while rows are sorted.
    values = F.array(*[
        F.struct(F.lit(k).alias("factor"), F.col(x).alias("x"),
                 *[F.col(f"ry_{y}_{k}").alias(f"ry_{y}") for y in returns])
        for k, x in enumerate(names)])
    rows = rows.select("time", *returns, F.inline(values)).filter(F.col("x").isNotNull())
    group = ["time", "factor"]
    rows = with_masked_ranks(
        rows, group, "x", {f"rx_{y}": F.col(y).isNotNull() for y in returns})
    # One pass over the values: each lag has its own moments, over the rows that have its return.
    # Lags become rows only in the small result.
    def moments(y: str) -> list[Column]:
        there = F.col(y).isNotNull()
        columns = [F.when(there, F.col(c)) for c in ("x", f"rx_{y}", f"ry_{y}")]
        x, rx, ry = columns
        return [safe_corr(x, F.col(y)).alias(f"ic_{y}"), safe_corr(rx, ry).alias(f"rank_ic_{y}"),
                F.count(y).alias(f"n_{y}")]

    daily = rows.groupBy(*group).agg(F.count("*").alias("n_values"), *[m for y in returns for m in moments(y)])
    by_lag = F.array(*[
        F.struct(F.lit(n).alias("lag"), F.col(f"ic_{y}").alias("ic"), F.col(f"rank_ic_{y}").alias("rank_ic"),
                 F.col(f"n_{y}").alias("n_stocks")) for n, y in zip(lags, returns)])
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("factor") + 1)
    return (
        daily.select("time", name.alias("factor_name"), "n_values", F.inline(by_lag))
        .filter(F.col("n_stocks") > 0)
        .select("time", "lag", "factor_name", "ic", "rank_ic", "n_stocks", *["n_values"] * counts)
    )


DAY = "time timestamp, lag int, factor int, ic double, rank_ic double, n_stocks long, n_values long"


def _day_ics(n_names: int, n_lags: int) -> Callable[[pa.Table], pa.Table]:
    """The ICs of one day, for ``applyInArrow``: one row per (lag, factor) with a pair (``DAY``)."""

    def ranks(values: np.ndarray) -> np.ndarray:
        """Average ranks of ascending values."""
        starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        ends = np.append(starts[1:], len(values))
        return np.repeat((starts + ends + 1) / 2.0, ends - starts)

    def corr(x: np.ndarray, y: np.ndarray) -> float | None:
        # Taken from the first value, so that equal values have no variance at all.
        x, y = x - x[0], y - y[0]
        x, y = x - x.mean(), y - y.mean()
        spread = math.sqrt(float(x @ x)) * math.sqrt(float(y @ y))
        return float(x @ y) / spread if spread else None

    def day(rows: pa.Table) -> pa.Table:
        columns = [c.to_numpy() for c in rows.columns[1:]]
        orders = [np.argsort(c, kind="stable") for c in columns]
        known = [~np.isnan(c) for c in columns]
        place = np.empty(rows.num_rows)
        found = []
        for lag in range(n_names, n_names + n_lags):
            for k in range(n_names):
                both = known[k] & known[lag]
                if not both.any():
                    continue
                told = []
                for c in (k, lag):
                    kept = orders[c][both[orders[c]]]
                    place[kept] = ranks(columns[c][kept])
                    told.append(place[both])
                found.append((lag - n_names, k, corr(columns[k][both], columns[lag][both]), corr(*told),
                              int(both.sum()), int(known[k].sum())))
        at = pa.array([rows.column(0)[0].as_py()] * len(found), rows.schema.field(0).type)
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([at, *[pa.array([f[j] for f in found], kind) for j, kind in enumerate(kinds)]],
                                    names=["time", "lag", "factor", "ic", "rank_ic", "n_stocks", "n_values"])

    return day


def _long_day_ics(names: list[str], lags: list[int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for ``cogroup``, from the long factor values and the returns of one day."""
    day, names, n_lags = _day_ics(len(names), len(lags)), list(names), len(lags)

    def nothing(time: pa.DataType) -> pa.Table:
        kinds = {"time": time, "lag": pa.int32(), "factor": pa.int32(), "ic": pa.float64(),
                 "rank_ic": pa.float64(), "n_stocks": pa.int64(), "n_values": pa.int64()}
        return pa.schema(list(kinds.items())).empty_table()

    def both(values: pa.Table, returns: pa.Table) -> pa.Table:
        if not values.num_rows:
            return nothing(returns["day"].type)
        symbols, which = pc.unique(values["symbol"]), values["factor"].to_numpy()
        at = pc.index_in(values["symbol"], value_set=symbols).to_numpy().astype(np.int64)
        cells, times = np.unique(at * len(names) + which, return_counts=True)
        if len(cells) < values.num_rows:
            raise ValueError(f"repeated key for factor {names[cells[times > 1][0] % len(names)]}")
        # Rows are those of the returns: values on days without a bar stay out.
        place = pc.index_in(returns["stock"], value_set=symbols) if returns.num_rows else None
        if place is None or place.null_count == len(place):
            return nothing(values["time"].type)
        met = pc.is_valid(place)
        returns, place = returns.filter(met), place.filter(met).to_numpy().astype(np.int64)
        grid = np.full((len(names), len(symbols)), np.nan)
        grid[which, at] = values["value"].to_numpy()
        columns = [returns["day"], *[pa.array(row[place]) for row in grid], *returns.columns[2:2 + n_lags]]
        return day(pa.Table.from_arrays(columns, names=["time", *[f"x{k}" for k in range(len(columns) - 1)]]))

    return both


def _split(rows: DataFrame, bound: int | None, most: int = DAY_ROWS) -> bool:
    """Is a day of ``rows`` too many for one task?"""
    return oversized(rows, ["time"], bound, min(most, row_limit(rows.sparkSession))) is not None


def _named(daily: DataFrame, names: list[str], lags: list[int], counts: bool = False) -> DataFrame:
    """Rows of ``DAY`` with lags and names for their numbers."""

    def named(values: list, at: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(at) + 1)

    return daily.select("time", named(lags, "lag").alias("lag"), named(names, "factor").alias("factor_name"),
                        *[F.round(c, CORR_DIGITS).alias(c) for c in ("ic", "rank_ic")], "n_stocks",
                        *["n_values"] * counts)


def _finite(columns: list[str]) -> list[Column]:
    return [F.when(finite(c), F.col(c).cast("double")).alias(c) for c in columns]


def _daily_ic(rows: DataFrame, names: list[str], lags: list[int], bound: int | None) -> DataFrame:
    """Wide rows are shuffled by day once; a task takes the cross-section of one day at a time, orders each
    column once and ranks each pair among the rows that have both. Days above ``DAY_ROWS`` are split.
    """
    returns = _lag_columns(lags)
    rows = rows.select("time", *_finite([*names, *returns]))
    if _split(rows, bound):
        return _daily_ic_split(rows, names, lags)
    return _named(rows.groupBy("time").applyInArrow(_day_ics(len(names), len(lags)), DAY), names, lags)


def daily_ic(factors: DataFrame, returns: DataFrame, names: list[str], lags: list[int],
             symbol_bound: int | None = None, day_bound: int | None = None, counts: bool = False) -> DataFrame:
    """The same from a long factor table, whose values and the forward returns are shuffled by day once: a task joins
    the two sides of one day and makes columns of the ``names``.

    Two rows of one (time, symbol, factor) are an error. With ``counts``, ``n_values`` is the number of values on the day
    that have a bar, whether or not a return is known. Where a day is too many rows for one task, the sides are joined by
    (time, symbol).
    """
    returns = returns.select(*ID, "pct_change")
    ahead = with_forward_returns(returns, lags, bound=symbol_bound)
    # Each row of a day stands for up to as many values as there are names.
    if _split(returns, day_bound, max(1, DAY_ROWS // len(names))):
        joined = join_panel(to_wide(factors, names), ahead).select("time", *_finite([*names, *_lag_columns(lags)]))
        return _daily_ic_split(joined, names, lags, counts)
    number = F.coalesce(*[F.when(F.col("factor_name") == n, k) for k, n in enumerate(names)])
    values = factors.filter(F.col("factor_name").isin(names) & F.col("time").isNotNull() & F.col("symbol").isNotNull())
    values = values.select("time", "symbol", number.alias("factor"), *_finite(["factor_value"])).withColumnRenamed(
        "factor_value", "value")
    there = ahead.filter(F.col("time").isNotNull() & F.col("symbol").isNotNull()).select(
        F.col("time").alias("day"), F.col("symbol").alias("stock"), *_finite(_lag_columns(lags)))
    # Other names: a name that both sides have from one table would be taken for one column.
    daily = values.groupBy("time").cogroup(there.groupBy("day")).applyInArrow(_long_day_ics(names, lags), DAY)
    return _named(daily, names, lags, counts)


def ic_summary(daily: DataFrame) -> DataFrame:
    """Mean, deviation, information ratio, t statistic and win rate per (lag, factor)."""
    stats = daily.groupBy("lag", "factor_name").agg(
        F.avg("rank_ic").alias("mean_rank_ic"),
        F.stddev_samp("rank_ic").alias("rank_ic_std"),
        F.avg("ic").alias("mean_ic"),
        F.stddev_samp("ic").alias("ic_std"),
        win_rate("ic").alias("win_rate"),
        F.count("ic").alias("n_days"),
    )
    rank_ir = F.try_divide("mean_rank_ic", "rank_ic_std")
    ir = F.try_divide("mean_ic", "ic_std")
    return stats.select(
        "lag", "factor_name", "mean_rank_ic", "rank_ic_std", rank_ir.alias("rank_ic_ir"),
        "mean_ic", "ic_std", ir.alias("ic_ir"), (ir * F.sqrt("n_days")).alias("t_stat"),
        "win_rate", "n_days",
    )


def rank_factors(summary: DataFrame) -> DataFrame:
    """Best information ratio first; factors without one lead."""
    return summary.orderBy("lag", F.desc_nulls_first("ic_ir"), "factor_name")


def ic_decay(summary: DataFrame, lags: list[int]) -> DataFrame:
    """One row per factor, one ``lag_<n>`` column of ic_ir per lag."""
    return summary.groupBy("factor_name").agg(
        *[F.first(F.when(F.col("lag") == n, F.col("ic_ir")), True).alias(f"lag_{n}") for n in lags])


def null_ic_days(daily: DataFrame) -> DataFrame:
    """Days per (lag, factor) whose cross-section had no variance."""
    return daily.filter(F.col("ic").isNull()).groupBy("lag", "factor_name").agg(
        F.count(F.lit(1)).alias("n_days"))


def ic_stats(daily: DataFrame) -> DataFrame:
    """Mean, deviation, ratio and positive share of ic and rank_ic over complete days."""
    whole = daily.na.drop()

    def columns(c: str, prefix: str):
        ratio = F.coalesce(F.try_divide(F.avg(c), F.stddev_samp(c)), F.lit(0.0))
        return [F.avg(c).alias(f"{prefix}_mean"), F.stddev_samp(c).alias(f"{prefix}_std"),
                ratio.alias(f"{prefix}_ir"), win_rate(c).alias(f"{prefix}_positive")]

    return whole.agg(*columns("ic", "ic"), *columns("rank_ic", "rank_ic"),
                     F.count(F.lit(1)).alias("n_days"))


def ic_rolling(daily: DataFrame, rows: int = 20, bound: int | None = None) -> DataFrame:
    """Rolling means of ic and rank_ic over the complete days of each (lag, factor)."""

    def add(df: DataFrame, series: Series) -> DataFrame:
        return df.select("*", series.sma("ic", rows).alias("ic_ma"),
                         series.sma("rank_ic", rows).alias("rank_ic_ma"))

    return over_series(daily.na.drop(), add, by=["lag", "factor_name"], order="time",
                       before=rows - 1, bound=bound)

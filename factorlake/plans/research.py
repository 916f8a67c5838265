"""The evaluation run over stored tables: factors and returns of a range, summary and decay."""

from __future__ import annotations

from datetime import date, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.operators.reshape import require_factors
from factorlake.plans import ic
from factorlake.sources.export import write_report
from factorlake.sources.lake import Lake, as_double

LAGS = (1, 5, 10, 15, 20)


class IcRun(NamedTuple):
    daily: DataFrame
    summary: DataFrame
    decay: DataFrame


def ic_run(lake: Lake, start: date, end: date, names: list[str], lags: tuple[int, ...] = LAGS,
           report: str | None = None) -> IcRun:
    """IC of the stored factors ``names`` against stored returns, for days in [start, end].

    Returns reach past the end, as far as the longest lag needs. A factor without a stored row in
    the range is an error. With ``report`` the summary is also written there as CSV.
    """
    factors = lake.load_factors(start, end, names)
    require_factors(factors, names)
    returns = lake.load_returns(start, end, max(lags))
    # (time, symbol) is the key of the bars: a symbol has no more rows than the range has days.
    days = (end - start).days + 2 * max(lags) + 6
    daily = ic.daily_ic(factors, returns, names, list(lags), symbol_bound=days)
    summary = ic.ic_summary(daily)
    if report:
        write_report(ic.rank_factors(summary), report)
    return IcRun(daily, summary, ic.ic_decay(summary, list(lags)))


# Days after which a return that is still missing is no longer waited for.
GIVE_UP_DAYS = 365


def update_ic(lake: Lake, as_of: date, names: list[str], lags: tuple[int, ...] = LAGS,
              give_up_days: int = GIVE_UP_DAYS) -> int:
    """Bring the table ``ic_daily`` up to ``as_of``; returns the rows it wrote.

    A day stays pending for a lag while stocks with a factor value have no bar that many rows ahead, at most
    ``give_up_days``. A run computes new days and completes pending ones; factors and returns are read from the
    earliest of these on. So runs day by day leave the rows of one run over all days.
    """
    factors = lake.load_factors(None, as_of, names)
    oldest = as_of - timedelta(days=give_up_days)
    known = lake.scan("ic_daily").filter(F.col("factor_name").isin(names) & F.col("lag").isin(*lags))
    full = known.groupBy("time", "factor_name").agg(
        F.count("*").alias("lags"), F.max("n_open").alias("open"))
    settled = full.filter((F.col("lags") == len(lags)) & ((F.col("open") == 0) | (F.col("time") < F.lit(oldest))))
    todo = factors.select("time", "factor_name").distinct().join(settled, ["time", "factor_name"], "left_anti")
    first = todo.agg(F.min("time").cast("date").alias("d")).first()["d"]
    if first is None:
        return 0
    values = lake.load_factors(first, as_of, names)
    returns = as_double(lake.scan("daily", first, as_of)).select("time", "symbol", "pct_change")
    days = (as_of - first).days + 1
    # Stocks that could have a return are the values on days with a bar. What is settled is left out of the small result:
    # days of one factor do not depend on each other.
    daily = ic.daily_ic(values, returns, names, list(lags), symbol_bound=days, counts=True)
    rows = daily.join(todo, ["time", "factor_name"], "left_semi").withColumn("n_open", F.col("n_values") - F.col("n_stocks"))
    return lake.upsert("ic_daily", rows.drop("n_values"))


def stored_span(lake: Lake) -> tuple[date, date] | None:
    """The first and last day with a bar."""
    row = lake.scan("daily").agg(F.min("time").cast("date").alias("lo"),
                                 F.max("time").cast("date").alias("hi")).first()
    return None if row["lo"] is None else (row["lo"], row["hi"])

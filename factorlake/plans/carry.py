"""Factor runs that go on from the state of each symbol at a month's end.

A state holds what later values depend on: the number of rows so far, the last closes and the
exponentially weighted means. It also counts and hashes the bars of its month; a month whose bars are no longer
those is not gone on from. So a run reads the month it verifies and those from its first day on,
however long the history is, and its values are those of a run over all of it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorlake.functions.ewm import COUNT, MEMORY, OLD, TAIL, Ewm, carry, place, so_far
from factorlake.operators.groups import measure
from factorlake.operators.ordered import BLOCK, POS, over_series
from factorlake.operators.reshape import ID, to_long
from factorlake.plans.factors import FEATURES, LONG_MA, LookBack, add_features, needed_features, select_factors
from factorlake.sources.lake import Lake, as_double

MEANS = tuple(f.name for f in FEATURES if isinstance(f, Ewm))
CLOSES = LONG_MA - 1
MONTH = "__month"


def _resumed(bars: DataFrame, state: DataFrame | None) -> DataFrame:
    """The bars behind the kept closes of their symbol, with the columns of a resumed series."""
    if state is None:
        nothing = [F.lit(None).cast("double").alias(carry(m)) for m in MEANS]
        zero = F.lit(0).cast("long")
        return bars.select("*", F.lit(False).alias(OLD), zero.alias(TAIL), zero.alias(COUNT), *nothing)
    known = state.select("symbol", F.size("closes").cast("long").alias(TAIL), F.col("n").alias(COUNT),
                         *[F.col(m).alias(carry(m)) for m in MEANS],
                         F.unix_micros(F.col("time") + F.make_ym_interval(F.lit(0), F.lit(1))).alias("__next"), "closes")
    zero = F.lit(0).cast("long")
    new = bars.join(known.drop("__next", "closes"), "symbol", "left").withColumns(
        {TAIL: F.coalesce(TAIL, zero), COUNT: F.coalesce(COUNT, zero), OLD: F.lit(False)})
    # Kept closes stand in the last microseconds before the bars that follow.
    old = known.select("*", F.posexplode("closes").alias("__k", "close"), F.lit(True).alias(OLD)).withColumn(
        "time", F.timestamp_micros(F.col("__next") - F.col(TAIL) + F.col("__k"))).drop("__k", "__next", "closes")
    return new.unionByName(old, allowMissingColumns=True)


def replay(bars: DataFrame, state: DataFrame | None, names: list[str] | None = None,
           bound: int | None = None, ends: bool = True) -> DataFrame:
    """One column per factor for the bars, which all come after the month of ``state`` (None: from the start).

    With the columns of a state (n, closes and means, the closes only on the last row of a symbol's month)
    and ``month_end``, which tells these rows. Without ``ends`` there are none of these, and only the means that the
    factors need are computed.
    """
    factors = select_factors(names)
    features = needed_features(factors, MEANS if ends else ())
    before = max(CLOSES, *[f.rows for f in features if isinstance(f, LookBack)]) + 2 * MEMORY
    rows = _resumed(bars.filter(F.col("close").isNotNull()), state).withColumn(MONTH, F.trunc("time", "month"))
    kept = [c for c in bars.columns if c not in {f.name for f in factors}]

    def add(df, series):
        df = add_features(df, series, features, resumed=True)
        if not ends:
            keys = [c for c in (POS, BLOCK) if c in df.columns]
            return df.select(*kept, *keys, OLD, *[f.build().alias(f.name) for f in factors])
        last = F.coalesce(series.ahead(MONTH) != F.col(MONTH), F.lit(True))
        closes = F.collect_list("close").over(series.last(CLOSES))
        df = df.select("*", (place(True) + 1).alias("n"), last.alias("month_end"), closes.alias("__closes"))
        keys = [c for c in (POS, BLOCK) if c in df.columns]
        return df.select(*kept, *keys, OLD, MONTH, *[f.build().alias(f.name) for f in factors], "n", "month_end",
                         F.when(F.col("month_end"), F.col("__closes")).alias("closes"),
                         *[so_far(m) for m in MEANS])

    out = over_series(rows, add, by=["symbol"], order="time", before=before, after=1, bound=bound)
    return out.filter(~F.col(OLD)).drop(OLD)


def _covered(bars: DataFrame) -> DataFrame:
    """Rows of each symbol and month, and a hash of all that factors read of them."""
    read = F.xxhash64(F.unix_micros("time"), "close", "high")
    return bars.filter(F.col("close").isNotNull()).groupBy("symbol", F.trunc("time", "month").alias(MONTH)).agg(
        F.count("*").alias("month_n"), F.bit_xor(read).alias("month_hash"))


def states(rows: DataFrame, bars: DataFrame, state: DataFrame | None, first: date, last: date) -> DataFrame:
    """States at the end of the months ``first`` to ``last`` (first days), from the rows of ``replay``.

    Every symbol seen so far has one for each month; without bars in it, it is that of the month before.
    """
    ends = rows.filter("month_end").join(_covered(bars), ["symbol", MONTH]).select(
        F.col(MONTH).cast("timestamp").alias("time"), "symbol", "n", "month_n", "month_hash", "closes",
        *[F.col(so_far(m)).alias(m) for m in MEANS])
    if state is not None:
        ends = ends.unionByName(state.select(*ends.columns))
    following = F.lead("time").over(Window.partitionBy("symbol").orderBy("time")).cast("date")
    ends = ends.withColumn("__until", F.coalesce(F.add_months(following, -1), F.lit(last)))
    until = F.col("__until")
    start = F.greatest(F.col("time").cast("date"), F.lit(first))
    months = F.when(start <= until, F.sequence(start, until, F.expr("interval 1 month")))
    filled = ends.withColumn("__at", F.explode(months)).withColumn("__own", F.col("__at") == F.col("time").cast("date"))
    nothing = F.lit(0).cast("long")
    return filled.withColumns({
        "month_n": F.when(F.col("__own"), F.col("month_n")).otherwise(nothing),
        "month_hash": F.when(F.col("__own"), F.col("month_hash")).otherwise(nothing),
        "time": F.col("__at").cast("timestamp")}).drop("__at", "__own", "__until")


def _next(month: str) -> date:
    year, number = map(int, month.split("-"))
    return date(year + number // 12, number % 12 + 1, 1)


def _state(lake: Lake, month: str) -> DataFrame:
    return lake.scan("factor_state", f"{month}-01", f"{month}-01")


def _bars(lake: Lake, start: date | None, end_excl: date | None) -> DataFrame:
    bars = as_double(lake.scan("daily", start, end_excl, closed="left"))
    return bars.select("time", "symbol", "open", "high", "low", "close", "volume")


def verified(lake: Lake, month: str) -> bool:
    """Do the states of ``month`` cover just the bars that its partition holds now?"""
    start = date.fromisoformat(f"{month}-01")
    held = _covered(_bars(lake, start, _next(month))).select("symbol", "month_n", "month_hash")
    told = _state(lake, month).filter("month_n > 0").select("symbol", "month_n", "month_hash")
    both = held.unionByName(told).groupBy("symbol").agg(
        F.count("*").alias("n"), (F.min("month_n") == F.max("month_n")).alias("same_n"),
        (F.min("month_hash") == F.max("month_hash")).alias("same_hash"))
    return both.filter("n <> 2 or not same_n or not same_hash").isEmpty()


def base_state(lake: Lake, first: date) -> tuple[DataFrame | None, date | None]:
    """The state to go on from for bars of month ``first`` on, and the first day to read (None: all).

    States of complete months before that are missing are made first, from the last one that verifies.
    """
    first = first.replace(day=1)
    known = [m for m in lake.months("factor_state") if m < str(first)[:7]]
    while known and not verified(lake, known[-1]):
        known.pop()
    start = _next(known[-1]) if known else None
    state = _state(lake, known[-1]) if known else None
    if start == first:
        return state, start
    bars = _bars(lake, start, first)
    if start is None:
        # The first day that has a bar.
        oldest = bars.agg(F.min("time").cast("date").alias("d")).first()["d"]
        if oldest is None:
            return None, None
        begin = oldest.replace(day=1)
    else:
        begin = start
    end = F.add_months(F.lit(first), -1)
    last = lake.spark.range(1).select(end.alias("d")).first()["d"]
    lake.upsert("factor_state", states(replay(bars, state, ["ma20"]), bars, state, begin, last))
    return _state(lake, str(last)[:7]), first


def carried_factors(lake: Lake, first: date, end_excl: date | None, names: list[str] | None = None,
                    symbols: DataFrame | None = None, ends: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Factor columns of the bars from month ``first`` on, with the bars they are made of and their state.

    ``symbols`` (one row each) keeps the rows of these only and gives them its other columns.
    """
    state, start = base_state(lake, first)
    bars = _bars(lake, start, end_excl)
    # Counted before the join, whose shuffle serves the windows too.
    bound = measure(bars, ["symbol"]).largest + CLOSES
    if symbols is not None:
        bars = bars.join(symbols, "symbol")
        state = state and state.join(symbols, "symbol", "left_semi")
    return replay(bars, state, names, bound, ends), bars, state


def long_factors(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    chosen = [f.name for f in select_factors(names)]
    return to_long(rows.select(*ID, *chosen), chosen)

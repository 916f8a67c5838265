"""Technical and cross-sectional factors of every symbol in one window plan.

A factor is an expression over shared features. Features come in three kinds: look-back
columns over the symbol window, plain expressions, and exponentially weighted means. A run
collects the features its factors need, adds those of one kind together, and so sorts each
symbol once however many factors are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlake.functions.ewm import Ewm, add_ewms, range_ewms
from factorlake.functions.missing import clean
from factorlake.operators.groups import oversized
from factorlake.operators.ordered import POS, Series, over_series
from factorlake.operators.reshape import ID, to_long
from factorlake.session import durable

# Indicator windows and the daily price limit.
SHORT_MA, LONG_MA, RSI_N = 20, 60, 14
MACD_FAST, MACD_SLOW, MACD_SIGN = 12, 26, 9
LIMIT_RATIO = Decimal("1.1")

# Rows of one symbol that are handed to pandas at once.
BLOCK_ROWS = 4_096
# Column of the text of an error where a plug-in fails.
FAULT = "__fault"


@dataclass(frozen=True)
class LookBack:
    """A column over the symbol window reaching ``rows`` rows back."""

    name: str
    rows: int
    build: Callable[[Series], Column]


@dataclass(frozen=True)
class Derived:
    name: str
    needs: tuple[str, ...]
    build: Callable[[], Column]


def _span(n: int) -> float:
    return 2.0 / (n + 1)


# In dependency order.
FEATURES = (
    LookBack("prev_close", 1, lambda s: s.prev("close")),
    LookBack("ma20", SHORT_MA - 1, lambda s: s.sma("close", SHORT_MA)),
    LookBack("ma60", LONG_MA - 1, lambda s: s.sma("close", LONG_MA)),
    Derived("gain", ("prev_close",),
            lambda: F.greatest(F.coalesce(F.col("close") - F.col("prev_close"), F.lit(0.0)), F.lit(0.0))),
    Derived("loss", ("prev_close",),
            lambda: F.greatest(F.coalesce(F.col("prev_close") - F.col("close"), F.lit(0.0)), F.lit(0.0))),
    Ewm("avg_gain", "gain", 1 / RSI_N, 0, RSI_N),
    Ewm("avg_loss", "loss", 1 / RSI_N, 0, RSI_N),
    Ewm("ema_fast", "close", _span(MACD_FAST), 0, MACD_FAST),
    Ewm("ema_slow", "close", _span(MACD_SLOW), 0, MACD_SLOW),
    Derived("macd", ("ema_fast", "ema_slow"), lambda: F.col("ema_fast") - F.col("ema_slow")),
    Ewm("macd_signal", "macd", _span(MACD_SIGN), MACD_SLOW - 1, MACD_SIGN),
)
_BY_NAME = {f.name: f for f in FEATURES}


def limit_price(prev_close: str, ratio: Decimal = LIMIT_RATIO) -> Column:
    """Previous close times the ratio, half up to the cent, in decimal arithmetic."""
    return F.round(F.col(prev_close).cast("decimal(12,4)") * F.lit(ratio), 2)


def hits_limit(high: str = "high", prev_close: str = "prev_close",
               ratio: Decimal = LIMIT_RATIO) -> Column:
    """1.0 where the high reaches the limit price, else 0.0; null without either price."""
    reached = F.col(high).cast("decimal(12,4)") >= limit_price(prev_close, ratio)
    return reached.cast("int").cast("double")


@dataclass(frozen=True)
class Factor:
    """A named expression over the bar columns and the features it ``needs``."""

    name: str
    needs: tuple[str, ...]
    build: Callable[[], Column]


def _rsi() -> Column:
    strength = F.col("avg_gain") / F.nullif(F.col("avg_loss"), F.lit(0.0))
    return F.when(F.col("avg_loss") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + strength))


DEFAULT = (
    Factor("price_to_ma20", ("ma20",),
           lambda: F.try_divide(F.col("close") - F.col("ma20"), F.col("ma20"))),
    Factor("ma_cross", ("ma20", "ma60"),
           lambda: F.try_divide(F.col("ma20") - F.col("ma60"), F.col("ma60"))),
    Factor("rsi14", ("avg_gain", "avg_loss"), _rsi),
    Factor("macd_norm", ("macd", "macd_signal"),
           lambda: F.try_divide(F.col("macd") - F.col("macd_signal"), F.col("close"))),
    Factor("limit_up", ("prev_close",), hits_limit),
)
RAW = tuple(Factor(n, (n,), lambda n=n: F.col(n)) for n in ("ma20", "ma60", "macd"))
REGISTRY: dict[str, Factor] = {f.name: f for f in DEFAULT + RAW}
DEFAULT_NAMES = [f.name for f in DEFAULT]


def register(factor: Factor) -> None:
    REGISTRY[factor.name] = factor


def select_factors(names: list[str] | None) -> list[Factor]:
    unknown = [n for n in names or [] if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown factor {', '.join(unknown)}; available: {', '.join(REGISTRY)}")
    return [REGISTRY[n] for n in names or DEFAULT_NAMES]


def needed_features(factors: list[Factor], also: tuple[str, ...] = ()) -> list:
    """The features of ``factors`` and those named in ``also``, each after what it needs."""
    wanted, queue = set(), [n for f in factors for n in f.needs] + list(also)
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            feature = _BY_NAME[name]
            queue += [feature.source] if isinstance(feature, Ewm) else getattr(feature, "needs", ())
    wanted.discard("close")
    return [f for f in FEATURES if f.name in wanted]


_BY_NAME["close"] = Derived("close", (), lambda: F.col("close"))


def add_features(df: DataFrame, series: Series, features: list, resumed: bool = False) -> DataFrame:
    for kind, run in groupby(features, key=type):
        run = list(run)
        if kind is Ewm:
            df = add_ewms(df, series, run, resumed)
        elif kind is LookBack:
            df = df.select("*", *[f.build(series).alias(f.name) for f in run])
        else:
            df = df.select("*", *[f.build().alias(f.name) for f in run])
    return df


def factor_columns(bars: DataFrame, names: list[str] | None = None,
                   bound: int | None = None) -> DataFrame:
    """The bars with one column per factor. Rows without a close are left out.

    ``bound`` is an upper bound on the rows of one symbol, if known; see ``over_series``.
    """
    factors = select_factors(names)
    features = needed_features(factors)
    traded = bars.filter(F.col("close").isNotNull())
    kept = [c for c in bars.columns if c not in {f.name for f in factors}]
    sizes = oversized(traded, ["symbol"], bound)
    if sizes is not None:
        rows = _split_features(traded, features, sizes.total)
        return rows.select(*kept, *[f.build().alias(f.name) for f in factors])

    def add(df, series):
        df = add_features(df, series, features)
        return df.select(*kept, POS, *[f.build().alias(f.name) for f in factors])

    return over_series(traded, add, by=["symbol"], order="time", bound=0)


def _split_features(rows: DataFrame, features: list, total: int) -> DataFrame:
    """The features where a symbol is too many rows for one task: look-backs in blocks that carry the few
    rows they reach for, means by ranges."""
    for kind, run in groupby(features, key=type):
        run = list(run)
        if kind is Ewm:
            rows = range_ewms(rows, ["symbol"], "time", run, total)
        elif kind is LookBack:
            rows = over_series(rows, lambda df, s, run=run: df.select("*", *[f.build(s).alias(f.name) for f in run]),
                               by=["symbol"], order="time", before=max(f.rows for f in run))
        else:
            rows = rows.select("*", *[f.build().alias(f.name) for f in run])
    return rows


def compute_wide(bars: DataFrame, names: list[str] | None = None,
                 bound: int | None = None) -> DataFrame:
    """(time, symbol) and one column per factor; null where a factor has no value yet."""
    chosen = [f.name for f in select_factors(names)]
    return factor_columns(bars, names, bound).select(*ID, *chosen)


def compute_factors(bars: DataFrame, names: list[str] | None = None,
                    bound: int | None = None) -> DataFrame:
    """Long format: time, symbol, factor_name, factor_value, without missing values."""
    chosen = [f.name for f in select_factors(names)]
    return to_long(compute_wide(bars, names, bound), chosen)


@dataclass(frozen=True)
class PandasFactor:
    """A factor that only pandas can express: ``fn`` maps consecutive bars of one symbol to a series.

    ``lookback`` is the number of earlier rows a value depends on. ``fn`` always gets a block of ``BLOCK_ROWS`` rows,
    counted from the symbol's first, behind that many earlier rows, whose values are not used. So a value does not
    depend on how many rows there are or how they arrive: a task reads its symbols in order, batch by
    batch, and hands the last rows of a block over to the next.
    """

    name: str
    fn: Callable[[pd.DataFrame], pd.Series]
    lookback: int

    def compute(self, bars: DataFrame, bound: int | None = None) -> DataFrame:
        """Long rows of the factor; a symbol for which ``fn`` raises fails the job."""
        return self._long(self._wide(bars, bound))

    def compute_isolated(self, bars: DataFrame, bound: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Long rows of the symbols for which ``fn`` never raises, and (symbol, error) of the others."""
        wide = durable(self._wide(bars, bound, isolate=True).select(*ID, self.name, FAULT))
        failed = wide.filter(F.col(FAULT).isNotNull()).groupBy("symbol").agg(F.min(FAULT).alias("error"))
        # How many symbols fail is not bounded, so this is a join and no list.
        names = failed.select(F.col("symbol").alias("__failed"))
        kept = wide.join(names, F.col("symbol").eqNullSafe(F.col("__failed")), "left_anti")
        return self._long(kept), failed

    def _wide(self, bars: DataFrame, bound: int | None, isolate: bool = False) -> DataFrame:
        if oversized(bars, ["symbol"], bound) is None:
            return self._in_order(bars, isolate)
        # One symbol is too many rows for one task: its blocks are groups of their own.
        return over_series(bars, lambda df, series: self._in_blocks(df, series, isolate), by=["symbol"], order="time",
                           before=self.lookback, bound=bound, limit=max(BLOCK_ROWS, self.lookback))

    def _long(self, wide: DataFrame) -> DataFrame:
        return clean(wide.select(*ID, F.lit(self.name).alias("factor_name"), F.col(self.name).alias("factor_value")))

    def _schema(self, df: DataFrame, isolate: bool) -> T.StructType:
        fault = [T.StructField(FAULT, T.StringType())] if isolate else []
        return T.StructType([*df.schema.fields, T.StructField(self.name, T.DoubleType()), *fault])

    def _values(self, isolate: bool) -> Callable[[pd.DataFrame, int], dict]:
        """The columns to add to the last rows of a block."""
        name, fn, fault = self.name, self.fn, FAULT

        def values(rows: pd.DataFrame, n: int) -> dict:
            if not isolate:
                return {name: fn(rows).astype("float64").tail(n).to_numpy()}
            try:
                return {name: fn(rows).astype("float64").tail(n).to_numpy(), fault: None}
            except Exception as error:
                return {name: np.nan, fault: f"{type(error).__name__}: {error}"}

        return values

    def _in_blocks(self, df: DataFrame, series: Series, isolate: bool) -> DataFrame:
        # Only plain values go into the task: workers need not have this package.
        values, order = self._values(isolate), series.order

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(order, ignore_index=True)
            return rows.assign(**values(rows, len(rows)))

        return df.groupBy(*series.by).applyInPandas(one, self._schema(df, isolate))

    def _in_order(self, bars: DataFrame, isolate: bool) -> DataFrame:
        values, lookback = self._values(isolate), self.lookback
        size = max(BLOCK_ROWS, lookback)

        def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows of each symbol in turn: (rows handed over, rows of the block)."""
            symbol, before, held, count = None, None, [], 0
            for frame in frames:
                codes = pd.factorize(frame["symbol"])[0]
                starts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()] if len(frame) else []
                for lo, hi in zip(starts, [*starts[1:], len(frame)]):
                    # In a list: a missing symbol is one like any other.
                    here = [None if codes[lo] < 0 else frame["symbol"].iloc[lo]]
                    if here != symbol:
                        if count:
                            yield before, pd.concat(held, ignore_index=True)
                        symbol, before, held, count = here, None, [], 0
                    while lo < hi:
                        part = frame.iloc[lo:min(hi, lo + size - count)]
                        held.append(part)
                        count += len(part)
                        lo += len(part)
                        if count == size:
                            block = pd.concat(held, ignore_index=True)
                            yield before, block
                            before, held, count = block.tail(lookback), [], 0
            if count:
                yield before, pd.concat(held, ignore_index=True)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for before, block in blocks(frames):
                rows = block if before is None else pd.concat([before, block], ignore_index=True)
                yield block.assign(**values(rows, len(block)))

        sorted_rows = bars.repartition("symbol").sortWithinPartitions("symbol", "time")
        return sorted_rows.mapInPandas(run, self._schema(bars, isolate))

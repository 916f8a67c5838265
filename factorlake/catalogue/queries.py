"""Registered queries: every operator run over the whole test tables.

Each entry takes the session and a table folder. Results are shown with ISO days, doubles
rounded to six digits and 64-bit integers, so that they compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress
from datetime import date, datetime, timedelta
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlake import functions as fn
from factorlake.functions.ewm import Ewm, MEMORY, add_ewms
from factorlake.operators import aggregates as agg
from factorlake.operators import columns as col
from factorlake.operators import joins, ranks, reshape
from factorlake.operators.ordered import over_series
from factorlake.operators.resample import resample, resample_minutes
from factorlake.plans import backtest as bt
from factorlake.plans import factors as fac
from factorlake.plans import ic, research, strategy, study
from factorlake.plans.incremental import factor_gaps, update_bars, update_factors
from factorlake.sources.status import PartialRun
from factorlake.session import bound_tasks, scratch, tidy
from factorlake.sources import export, landing
from factorlake.sources import testdata as td
from factorlake.sources.lake import Lake, as_double
from factorlake.sources.status import record_sync, reported
from factorlake.sources.upsert import merge_table
from factorlake.schemas import DAILY, FACTORS, SIGNALS, SYNC_STATUS
from factorlake.streaming import ingest, rollups

LAGS = [1, 5, 10, 15, 20]
DIGITS = 6
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


class Inputs:
    """The panel inputs of one table folder, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        bound_tasks(spark, self.table("lineitem").count())

    def table(self, name: str) -> DataFrame:
        return td.table(self.spark, self.dir, name)

    @cached_property
    def bounds(self) -> td.PanelBounds:
        return td.panel_bounds(self.spark, self.dir)

    @property
    def rows(self) -> int:
        """Most bars of one symbol."""
        return self.bounds.per_symbol

    @property
    def day(self) -> int:
        """Most bars of one day."""
        return self.bounds.per_date

    @cached_property
    def raw(self) -> DataFrame:
        return td.raw_bars(td.ticks(self.table("lineitem")))

    @cached_property
    def bars(self) -> DataFrame:
        return td.with_pct_change(self.raw, self.rows)

    @cached_property
    def stored(self) -> DataFrame:
        """The bars from files in the shared folder, where a query reads them more than once."""
        path = scratch(self.spark, "bars")
        with tidy(self.spark):
            self.bars.write.parquet(path)
        return self.spark.read.schema(self.bars.schema).parquet(path)

    @cached_property
    def stocks(self) -> DataFrame:
        return td.stocks(self.spark, self.dir)

    def wide(self, names: list[str] | None = None) -> DataFrame:
        return fac.compute_wide(self.bars, names, self.rows)

    def long(self, names: list[str] | None = None) -> DataFrame:
        return fac.compute_factors(self.bars, names, self.rows)

    def daily_ic(self, lags: list[int]) -> DataFrame:
        panel = fac.factor_columns(self.bars, None, self.rows)
        return ic.daily_ic_wide(panel, fac.DEFAULT_NAMES, lags, self.rows, self.day)

    @cached_property
    def study(self) -> DataFrame:
        return study.study_panel(self.bars, self.stocks, self.rows)

    @cached_property
    def study_next(self) -> DataFrame:
        return study.with_next_return(self.study, self.rows)

    @cached_property
    def signals(self) -> DataFrame:
        return strategy.momentum_from_wide(self.wide(strategy.MOMENTUM_FACTORS), bound=self.rows)

    @cached_property
    def returns(self) -> DataFrame:
        panel = fac.factor_columns(self.bars, strategy.MOMENTUM_FACTORS, self.rows)
        priced = strategy.momentum_from_wide(panel, bound=self.rows, keep=("pct_change",))
        return bt.signal_returns(priced, bound=self.rows)

    @cached_property
    def topk(self) -> DataFrame:
        return bt.topk_backtest(self.signals, self.bars, k=3, bound=self.rows)

    def portfolio(self) -> DataFrame:
        """The top-k returns as one series per strategy."""
        return self.topk.withColumn("strategy", F.lit("top3"))

    def lake(self) -> Lake:
        """A fresh table folder in the shared folder."""
        return Lake(self.spark, scratch(self.spark, "lake"))

    def stream(self, name: str) -> DataFrame:
        """One of the given tables as a file stream."""
        schema = self.table(name).schema
        return (self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
                .parquet(self.dir))


def shown(df: DataFrame) -> DataFrame:
    columns = []
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), DIGITS)
        elif isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: shown(build(Inputs(spark, sf_dir)))
    return build


# -- scans and landing -------------------------------------------------------------------


@query
def bars_daily(i: Inputs) -> DataFrame:
    return i.bars


@query
def normalize_bars(i: Inputs) -> DataFrame:
    return landing.normalize_bars(landing.to_vendor(i.bars))


@query
def scan_symbol(i: Inputs) -> DataFrame:
    return landing.scan_bars(i.bars, symbols=["000001.SH"], start="1996-01-01", end="1998-12-31")


@query
def scan_dates(i: Inputs) -> DataFrame:
    days = [F.lit(d).cast("timestamp") for d in ("1996-03-04", "1997-06-05", "2050-01-01")]
    return landing.scan_bars(i.bars, dates=days)


@query
def load_panel_range(i: Inputs) -> DataFrame:
    return col.in_range(i.bars, "time", "1996-01-01", "1997-01-01", "left").select(
        "time", "symbol", "open", "high", "low", "close", "pct_change")


@query
def returns_padded(i: Inputs) -> DataFrame:
    until = shift_end("1998-06-30", max(LAGS))
    return i.bars.filter((F.col("time") >= "1998-01-01") & (F.col("time") <= until)).select(
        "time", "symbol", "pct_change")


def shift_end(day: str, max_lag: int):
    return fn.shift_days(F.lit(day).cast("date"), 2 * max_lag + 5)


@query
def latest_n(i: Inputs) -> DataFrame:
    return col.latest_n(i.bars, "000001.SH", 20)


@query
def head_tail(i: Inputs) -> DataFrame:
    order = ["time", "symbol"]
    return col.concat([col.with_const(col.head(i.bars, 5, order), "part", "head"),
                       col.with_const(col.tail(i.bars, 5, order), "part", "tail")])


@query
def sql_query(i: Inputs) -> DataFrame:
    i.raw.createOrReplaceTempView("daily_bars_view")
    return i.spark.sql("""
        SELECT time, symbol, close, volume FROM daily_bars_view
        WHERE symbol = '000002.SZ' AND close > 100 ORDER BY time DESC LIMIT 50""")


@query
def stocks_dimension(i: Inputs) -> DataFrame:
    return i.stocks


@query
def index_bars(i: Inputs) -> DataFrame:
    return td.index_daily(i.bars).na.drop()


@query
def export_scan(i: Inputs) -> DataFrame:
    return export.scan_export(i.bars)


# -- projections, filters, scalars --------------------------------------------------------


@query
def derived_columns(i: Inputs) -> DataFrame:
    named = col.rename(i.bars, {"pct_change": "change"})
    wider = col.derive(named, spread=F.col("high") - F.col("low"),
                       range_pct=F.try_divide(F.col("high") - F.col("low"), "open"))
    typed = col.cast(col.with_const(col.with_const(wider, "source", "bars"), "note", None, "string"),
                     {"volume": "double"})
    return typed.select("time", "symbol", "change", "spread", "range_pct", "source", "note", "volume")


@query
def universe_filter(i: Inputs) -> DataFrame:
    members = col.in_universe(i.stocks, "exchange", ["SZ"])
    kept = col.in_universe(col.in_universe(i.bars, "symbol", members), "symbol", None)
    return kept.select("time", "symbol", "close")


@query
def missing_values(i: Inputs) -> DataFrame:
    gaps = i.bars.select(
        "time", "symbol",
        F.when(F.col("volume") > 50, F.lit(float("nan"))).otherwise(F.col("close")).alias("x"),
        F.when(F.col("open") > 108, F.lit(float("inf"))).otherwise(F.col("open")).alias("y"),
        "pct_change")
    return gaps.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(fn.present("x")).alias("n_present"),
        F.count_if(fn.finite("y")).alias("n_finite"),
        F.count_if(fn.present("x") & fn.present("pct_change")).alias("n_complete"),
        F.sum(fn.nan_to("x", 0.0)).alias("sum_nan_zero"),
        F.count(fn.null_if_nan("x")).alias("n_after_nan_null"),
        F.sum(F.coalesce("pct_change", F.lit(0.0))).alias("sum_null_zero"),
    )


@query
def drop_missing(i: Inputs) -> DataFrame:
    wide = i.wide(["ma20", "ma60", "rsi14"])
    return col.drop_nulls(fn.drop_any_nan(wide, ["ma20", "rsi14"]), ["ma60"])


@query
def scalar_functions(i: Inputs) -> DataFrame:
    day = fn.fmt_day("time")
    return i.bars.select(
        "time", "symbol",
        fn.to_prefix_code("symbol").alias("code"),
        F.lower(fn.to_prefix_code("symbol")).alias("code_lower"),
        day.alias("day_text"),
        fn.parse_day(day).alias("day_parsed"),
        fn.fmt_day("time", "yyyy-MM-dd").alias("iso"),
        fn.to_naive_day("time").alias("naive_day"),
        fn.shift_days("time", -90).alias("warmup_start"),
        fn.bucket("time", "week").alias("week"),
        fn.bucket("time", "month").alias("month"),
        fn.round_half_up(F.col("close") / F.col("open"), 4).alias("ratio4"),
        fac.limit_price("close").alias("next_limit"),
        F.sqrt(F.col("volume").cast("double")).alias("root_volume"),
        F.abs(F.col("close") - F.col("open")).alias("move"),
        F.pow(F.col("close") / 100, F.lit(2.0)).alias("squared"),
    )


@query
def json_metadata(i: Inputs) -> DataFrame:
    with_data = F.when(F.col("volume") > 25, F.struct(F.col("volume").alias("volume")))
    return i.bars.select("time", "symbol", fn.metadata_to_json(with_data).alias("metadata"))


@query
def error_texts(i: Inputs) -> DataFrame:
    # Six symbols per exchange are enough for a text of the first five.
    flagged = i.stocks.filter("is_st = 1").withColumn("one", F.lit(1))
    few = ranks.top_k(flagged, ["exchange"], "one", 6).groupBy("exchange").agg(
        F.sort_array(F.collect_list("symbol")).alias("symbols"))
    return few.select("exchange", fn.join_errors("symbols", 5).alias("first_errors"))


# -- calendars and joins -------------------------------------------------------------------


@query
def symbol_list(i: Inputs) -> DataFrame:
    return agg.symbols(i.raw)


@query
def symbol_count(i: Inputs) -> DataFrame:
    return agg.n_symbols(i.raw)


@query
def trading_calendar(i: Inputs) -> DataFrame:
    return agg.trading_dates(i.raw)


@query
def trading_calendar_range(i: Inputs) -> DataFrame:
    return agg.trading_dates(i.raw, "1997-01-01", "1997-12-31")


@query
def calendar_from_symbol(i: Inputs) -> DataFrame:
    return agg.calendar_from(i.raw, "000001.SH")


@query
def calendar_lines(i: Inputs) -> DataFrame:
    return export.calendar_lines(export.scan_export(i.bars))


@query
def missing_dates(i: Inputs) -> DataFrame:
    days = agg.calendar(i.raw)
    return joins.missing_dates(days, days.filter(F.dayofmonth("time") != 15))


@query
def missing_dates_forced(i: Inputs) -> DataFrame:
    days = agg.calendar(i.raw)
    return joins.missing_dates(days, days.filter(F.dayofmonth("time") != 15), force=True)


@query
def missing_symbol_dates(i: Inputs) -> DataFrame:
    have = i.raw.filter((F.dayofmonth("time") != 15) | (F.col("volume") > 30))
    return joins.missing_dates(i.raw, have, grain=["time", "symbol"])


@query
def keep_missing_dates(i: Inputs) -> DataFrame:
    days = agg.calendar(i.raw)
    gaps = joins.missing_dates(days, days.filter(F.dayofmonth("time") != 15))
    return joins.keep_dates(i.bars, gaps)


@query
def instruments(i: Inputs) -> DataFrame:
    return agg.instruments(i.raw)


@query
def instrument_lines(i: Inputs) -> DataFrame:
    return export.instrument_lines(export.scan_export(i.bars))


@query
def dense_panel(i: Inputs) -> DataFrame:
    return export.dense_panel(export.scan_export(i.bars), bound=i.rows)


@query
def dense_arrays(i: Inputs) -> DataFrame:
    arrays = export.dense_panel(export.scan_export(i.bars), as_arrays=True, bound=i.rows)
    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    return arrays.select("instrument", F.size("close").alias("n_days"),
                         F.size(F.array_compact("close")).alias("n_bars"),
                         total("close").alias("close_sum"), total("volume").alias("volume_sum"))


@query
def symbol_codes(i: Inputs) -> DataFrame:
    return agg.symbols(i.raw).select("symbol", fn.to_prefix_code("symbol").alias("code"))


@query
def stocks_attached(i: Inputs) -> DataFrame:
    known = i.stocks.filter("exchange = 'SZ'")
    return joins.attach_dim(i.raw, known, "symbol", {"is_st": 0}).select("time", "symbol", "is_st")


# -- resampling ------------------------------------------------------------------------------


@query
def bars_weekly(i: Inputs) -> DataFrame:
    return resample(i.raw, "week")


@query
def bars_monthly(i: Inputs) -> DataFrame:
    return resample(i.raw, "month")


def _minutes(i: Inputs, freq: str) -> DataFrame:
    bars = resample_minutes(td.event_ticks(i.spark, i.dir), freq)
    return bars.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


@query
def minute_5m(i: Inputs) -> DataFrame:
    return _minutes(i, "5m")


@query
def minute_60m(i: Inputs) -> DataFrame:
    return _minutes(i, "60m")


@query
def minute_15m_from_5m(i: Inputs) -> DataFrame:
    five = resample_minutes(td.event_ticks(i.spark, i.dir), "5m")
    return resample_minutes(five, "15m").withColumn(
        "time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


# -- window functions and factors -------------------------------------------------------------


def _series(i: Inputs, before: int, after: int = 0, **columns) -> DataFrame:
    def add(df, s):
        return df.select("*", *[build(s).alias(n) for n, build in columns.items()])

    out = over_series(i.bars, add, by=["symbol"], order="time", before=before, after=after,
                      bound=i.rows)
    return out.select("time", "symbol", *columns)


@query
def sma20(i: Inputs) -> DataFrame:
    return _series(i, 19, sma20=lambda s: s.sma("close", 20))


@query
def vol_ma5(i: Inputs) -> DataFrame:
    return _series(i, 4, vol_ma5=lambda s: s.sma("volume", 5))


@query
def lag_diff_lead(i: Inputs) -> DataFrame:
    return _series(i, 1, 2, prev_close=lambda s: s.prev("close"), change=lambda s: s.diff("close"),
                   close_in_2=lambda s: s.ahead("close", 2))


@query
def ewm12(i: Inputs) -> DataFrame:
    spec = Ewm("ewm12", "close", 2 / 13, 0, 12)
    out = over_series(i.bars, lambda df, s: add_ewms(df, s, [spec]), by=["symbol"], order="time",
                      before=MEMORY, bound=i.rows)
    return out.select("time", "symbol", "ewm12")


def _one_factor(name: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: shown(Inputs(spark, sf_dir).long([name]))


for _name in fac.REGISTRY:
    _one_factor(_name)


@query
def factors_long(i: Inputs) -> DataFrame:
    return i.long()


@query
def factors_wide(i: Inputs) -> DataFrame:
    return reshape.to_wide(i.long(), fac.DEFAULT_NAMES)


@query
def missing_factors(i: Inputs) -> DataFrame:
    return reshape.missing_factors(i.long(), [*fac.DEFAULT_NAMES, "ma60", "turnover"])


@query
def custom_factor(i: Inputs) -> DataFrame:
    amplitude = fac.PandasFactor(
        "amplitude5", lambda p: (p["high"].rolling(5).max() - p["low"].rolling(5).min()) / p["close"], 4)
    return amplitude.compute(i.bars.select("time", "symbol", "high", "low", "close"), i.rows)


@query
def fwd_ret_lag1(i: Inputs) -> DataFrame:
    return ic.forward_return(i.bars, 1, i.rows)


@query
def fwd_ret_lag5(i: Inputs) -> DataFrame:
    return ic.forward_return(i.bars, 5, i.rows)


# -- information coefficients -------------------------------------------------------------------


@query
def daily_ic_lag1(i: Inputs) -> DataFrame:
    return i.daily_ic([1])


@query
def daily_ic_long_lag5(i: Inputs) -> DataFrame:
    return ic.daily_ic(i.long(), i.bars, fac.DEFAULT_NAMES, [5], i.rows, i.day)


@query
def ic_summary(i: Inputs) -> DataFrame:
    return ic.rank_factors(ic.ic_summary(i.daily_ic(LAGS)))


@query
def ic_decay(i: Inputs) -> DataFrame:
    return ic.ic_decay(ic.ic_summary(i.daily_ic(LAGS)), LAGS)


@query
def ic_rolling20(i: Inputs) -> DataFrame:
    return ic.ic_rolling(i.daily_ic([1]), 20, i.rows)


@query
def ic_null_days(i: Inputs) -> DataFrame:
    return ic.null_ic_days(i.daily_ic([1]))


@query
def global_ic(i: Inputs) -> DataFrame:
    panel = fac.factor_columns(i.bars, None, i.rows)
    ahead = ic.with_forward_returns(panel, [1], bound=i.rows).withColumnRenamed("fwd_1", "fwd_ret")
    return agg.global_ic(ahead, fac.DEFAULT_NAMES)


@query
def cross_section_ranks(i: Inputs) -> DataFrame:
    ranked = ranks.with_avg_ranks(i.bars.na.drop(), ["time"], {"rank": "pct_change"}, i.day)
    return ranked.select("time", "symbol", "pct_change", "rank")


@query
def top_3_per_day(i: Inputs) -> DataFrame:
    return ranks.top_k(i.bars.na.drop().select("time", "symbol", "pct_change"), ["time"],
                       "pct_change", 3)


@query
def count_valid(i: Inputs) -> DataFrame:
    return col.count_valid(i.wide(), fac.DEFAULT_NAMES, ["symbol"])


# -- limit-up study ----------------------------------------------------------------------------


@query
def clean_universe(i: Inputs) -> DataFrame:
    return i.study.select("time", "symbol", "prev_close", "high", "limit_up_price", "is_limit_up",
                          "pct_change")


@query
def study_next_return(i: Inputs) -> DataFrame:
    return i.study_next.select("time", "symbol", "is_limit_up", "next_ret")


@query
def study_daily_ic(i: Inputs) -> DataFrame:
    return study.study_ic(i.study_next, i.day)


@query
def study_ic_stats(i: Inputs) -> DataFrame:
    return ic.ic_stats(study.study_ic(i.study_next, i.day))


@query
def group_stats(i: Inputs) -> DataFrame:
    return agg.group_stats(i.study_next, "is_limit_up", "next_ret")


@query
def symbol_median(i: Inputs) -> DataFrame:
    return ranks.exact_median(i.bars, ["symbol"], "pct_change", i.rows)


@query
def cond_means(i: Inputs) -> DataFrame:
    return study.cond_means(i.study_next)


@query
def ic_hist(i: Inputs) -> DataFrame:
    return agg.histogram(study.study_ic(i.study_next, i.day), "ic", 30)


@query
def ret_hist(i: Inputs) -> DataFrame:
    return agg.histogram(i.study_next, "next_ret", 60, (-10, 10), density=True, by=["is_limit_up"])


# -- strategy and backtest ------------------------------------------------------------------------


@query
def momentum_signals(i: Inputs) -> DataFrame:
    return i.signals


@query
def momentum_from_long(i: Inputs) -> DataFrame:
    factors = i.long(strategy.MOMENTUM_FACTORS)
    return strategy.run_strategy(strategy.MOMENTUM, factors, rsi_overbought=65.0, bound=i.rows)


@query
def momentum_universe(i: Inputs) -> DataFrame:
    """The universe is the feature: signals of a few named symbols."""
    factors = i.long(strategy.MOMENTUM_FACTORS)
    return strategy.run_strategy(strategy.MOMENTUM, factors, ["000001.SH", "000002.SZ", "000003.SH"],
                                 bound=i.rows)


@query
def signal_counts(i: Inputs) -> DataFrame:
    return strategy.signal_counts(i.signals)


@query
def signal_returns(i: Inputs) -> DataFrame:
    return i.returns


@query
def signal_returns_joined(i: Inputs) -> DataFrame:
    return bt.signal_returns(i.signals, i.bars, i.rows)


@query
def signal_returns_bucketed(i: Inputs) -> DataFrame:
    """The same from catalog tables bucketed by symbol."""
    lake, database = i.lake(), "factorlake_buckets"
    i.spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    lake.upsert("daily", i.bars)
    lake.upsert("trading_signals", i.signals.withColumn("metadata", fn.metadata_to_json()))
    bars, signals = (lake.publish_by_symbol(database, n, 8) for n in ("daily", "trading_signals"))
    return bt.signal_returns(signals.drop("metadata"), bars.select("time", "symbol", "pct_change"), i.rows)


@query
def equity_curve(i: Inputs) -> DataFrame:
    return bt.equity_curve(i.returns, ["strategy", "symbol"], bound=i.rows).select(
        "time", "symbol", "strategy", "equity", "drawdown")


@query
def metrics(i: Inputs) -> DataFrame:
    return bt.metrics(i.returns, ["strategy", "symbol"], bound=i.rows)


@query
def metrics_weekly(i: Inputs) -> DataFrame:
    weekly = i.returns.groupBy("strategy", "symbol", fn.bucket("time", "week").alias("week")).agg(
        F.sum("strategy_ret").alias("strategy_ret"))
    return bt.metrics(weekly, ["strategy", "symbol"], "weekly", order="week", bound=i.rows)


@query
def risk_analysis(i: Inputs) -> DataFrame:
    return bt.risk_analysis(i.returns, ["strategy", "symbol"], bound=i.rows)


@query
def score_panel(i: Inputs) -> DataFrame:
    return bt.score_panel(i.signals)


@query
def topk_backtest(i: Inputs) -> DataFrame:
    return i.topk


@query
def topk_metrics(i: Inputs) -> DataFrame:
    return bt.metrics(i.portfolio(), ["strategy"], bound=i.rows)


@query
def compare_metrics(i: Inputs) -> DataFrame:
    by = ["strategy"]
    gross = i.portfolio().withColumn("strategy_ret", F.col("gross_ret"))
    return bt.compare_metrics(bt.metrics(gross, by, bound=i.rows),
                              bt.metrics(i.portfolio(), by, bound=i.rows), by)


@query
def excess_return(i: Inputs) -> DataFrame:
    return bt.excess_return(i.portfolio(), td.index_daily(i.bars)).select(
        "time", "strategy", "strategy_ret", "bench_ret", "excess_ret")


@query
def rebalance_weekly(i: Inputs) -> DataFrame:
    return bt.rebalance(i.signals, "weekly")


@query
def rebalance_monthly(i: Inputs) -> DataFrame:
    return bt.rebalance(i.signals, "monthly")


# -- upserts, status, incremental -------------------------------------------------------------------


def _base_bars(i: Inputs) -> DataFrame:
    """Stored bars of most days, with an adjustment factor that no upsert may touch; the batch below
    brings the days left out and some of these again."""
    return i.bars.filter(F.dayofmonth("time") % 6 != 3).select(
        *landing.BAR_COLUMNS, F.lit(2.5).alias("adj_factor"), F.lit(True).alias("is_st"),
        F.lit(False).alias("is_suspended"))


def _incoming_bars(i: Inputs) -> DataFrame:
    """A batch of days divisible by three, each key twice: the second copy wins."""
    batch = i.bars.filter(F.dayofmonth("time") % 3 == 0)
    return batch.withColumn("seq", F.lit(1)).withColumn("volume", F.col("volume") + 7).unionByName(
        batch.withColumn("seq", F.lit(2)).withColumn("volume", F.col("volume") + 1))


@query
def upsert_bars(i: Inputs) -> DataFrame:
    return merge_table(DAILY, _base_bars(i), _incoming_bars(i), "seq")


@query
def upsert_factors(i: Inputs) -> DataFrame:
    factors = i.long(["price_to_ma20", "ma_cross"])
    base = factors.filter(F.dayofmonth("time") % 6 != 3)
    batch = factors.filter(F.dayofmonth("time") % 3 == 0).withColumn(
        "factor_value", F.col("factor_value") + 1)
    return merge_table(FACTORS, base, batch)


@query
def upsert_signals(i: Inputs) -> DataFrame:
    signals = i.signals.select("time", "symbol", "strategy", "signal", "score",
                               fn.metadata_to_json().alias("metadata"))
    base = signals.filter(F.dayofmonth("time") % 6 != 3)
    batch = signals.filter(F.dayofmonth("time") % 3 == 0).withColumn(
        "signal", F.lit(0)).withColumn("metadata", fn.metadata_to_json(F.struct(F.lit(1).alias("run"))))
    return merge_table(SIGNALS, base, batch)


@query
def sync_status(i: Inputs) -> DataFrame:
    def status(rows: DataFrame, seq: int) -> DataFrame:
        return rows.agg(F.max("time").cast("date").alias("last_date")).select(
            F.lit("daily").alias("data_type"), F.lit(None).cast("string").alias("symbol"),
            F.lit("2024-01-01").cast("timestamp").alias("last_sync_time"), "last_date",
            F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error_msg"),
            F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.lit(seq).alias("seq"))

    first = i.raw.filter(F.col("time") < "1998-01-01")
    base = status(first, 0).drop("seq")
    batch = status(i.raw, 2).unionByName(status(first, 1)).unionByName(
        status(i.raw, 1).withColumn("data_type", F.lit("factors")).withColumn("status", F.lit("error"))
        .withColumn("error_msg", fn.join_errors(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)))
    return merge_table(SYNC_STATUS, base, batch, "seq")


@query
def incremental_factors(i: Inputs) -> DataFrame:
    names = ["price_to_ma20", "ma_cross"]
    done = i.long(names).filter(F.col("time") < "2001-01-01")
    gaps = joins.missing_dates(i.bars, done)
    return factor_gaps(i.bars, gaps, names, bound=i.rows)


@query
def incremental_factors_warmup(i: Inputs) -> DataFrame:
    names = ["price_to_ma20", "ma_cross", "rsi14"]
    late = agg.calendar(i.bars).filter(F.col("time") >= "2001-01-01")
    return factor_gaps(i.bars, late, names, warmup_days=90, bound=i.rows)


@query
def lake_round_trip(i: Inputs) -> DataFrame:
    lake = i.lake()
    lake.upsert("daily", _base_bars(i))
    lake.upsert("daily", _incoming_bars(i), "seq")
    return as_double(lake.scan("daily"))


@query
def catalog_tables(i: Inputs) -> DataFrame:
    lake = i.lake()
    database = "factorlake_check"
    # The tables are external: dropping last run's entries touches no data.
    i.spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    lake.create_tables(database)
    lake.replace("weekly", resample(i.raw, "week"))
    lake.refresh_tables(database)
    return i.spark.sql(f"""
        SELECT symbol, count(*) AS n_weeks, CAST(max(close) AS DOUBLE) AS top_close
        FROM {database}.weekly GROUP BY symbol""")


@query
def minute_table(i: Inputs) -> DataFrame:
    lake = i.lake()
    ticks = td.event_ticks(i.spark, i.dir)
    for freq in ("5m", "60m"):
        lake.upsert("minute", resample_minutes(ticks, freq))
    stored = lake.load_minute("60m")
    return stored.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


@query
def index_table(i: Inputs) -> DataFrame:
    lake = i.lake()
    lake.upsert("index_daily", td.index_daily(i.bars))
    return lake.load_index("000300.SH").select(
        "time", "symbol", "pct_change")


@query
def update_bars_run(i: Inputs) -> DataFrame:
    lake = i.lake()
    landed = landing.to_vendor(i.bars)
    calendar = agg.calendar(i.raw)
    some = landed.filter("substr(trade_date, 7, 2) <> '15'")
    last = calendar.agg(F.max("time").cast("date").alias("d")).first()["d"]
    update_bars(lake, some, calendar, last, i.rows)
    update_bars(lake, landed, calendar, last, i.rows)
    return as_double(lake.scan("daily")).select(*landing.BAR_COLUMNS)


@query
def update_bars_partial(i: Inputs) -> DataFrame:
    lake = i.lake()
    landed = landing.to_vendor(i.bars)
    # On the 15th the closes of some symbols are no numbers.
    broken = F.expr("substr(trade_date, 7, 2) = '15' and ts_code like '%1%'")
    landed = landed.withColumn("close", F.when(broken, F.lit("n/a")).otherwise(F.col("close").cast("string")))
    calendar = agg.calendar(i.raw)
    last = calendar.agg(F.max("time").cast("date").alias("d")).first()["d"]
    try:
        update_bars(lake, landed, calendar, last, i.rows)
    except PartialRun as partial:
        assert partial.errors
    return as_double(lake.scan("daily")).select(*landing.BAR_COLUMNS)


@query
def update_factors_run(i: Inputs) -> DataFrame:
    lake = i.lake()
    lake.upsert("daily", i.bars)
    names = ["price_to_ma20", "limit_up"]
    first, last = research.stored_span(lake)
    update_factors(lake, first + (last - first) / 2, i.rows, names=names)
    update_factors(lake, last, i.rows, names=names)
    return lake.load_factors(names=names)


@query
def sync_status_run(i: Inputs) -> DataFrame:
    lake = i.lake()
    last = i.raw.agg(F.max("time").cast("date").alias("d")).first()["d"]
    when = datetime(2024, 1, 1)
    record_sync(lake, "daily", date(1995, 1, 1), as_of=when)
    record_sync(lake, "daily", last, as_of=when)
    record_sync(lake, "factors", last, ["a", "b", "c"], error_limit=2, as_of=when)
    record_sync(lake, "ic", date(1995, 1, 2), as_of=when)
    with suppress(ValueError), reported(lake, "ic", when):
        raise ValueError("no factors")
    return lake.scan("sync_status")


@query
def ic_report(i: Inputs) -> DataFrame:
    path = f"{i.lake().root}/report"
    export.write_report(ic.ic_summary(i.daily_ic([1])), path)
    return i.spark.read.schema(
        "lag int, factor_name string, mean_rank_ic double, rank_ic_std double, rank_ic_ir double, "
        "mean_ic double, ic_std double, ic_ir double, t_stat double, win_rate double, n_days long",
    ).option("header", True).csv(path)


@query
def ic_run(i: Inputs) -> DataFrame:
    """The evaluation run over stored factors and returns."""
    lake = i.lake()
    lake.upsert("daily", i.bars)
    lake.upsert("daily_factors", fac.compute_factors(lake.load_ohlcv(), bound=i.rows))
    first, last = research.stored_span(lake)
    return research.ic_run(lake, first, last, fac.DEFAULT_NAMES, tuple(LAGS)).summary


@query
def ic_store(i: Inputs) -> DataFrame:
    """Daily ICs kept up to date in two runs, the second of which completes days of the first."""
    lake, names, lags = i.lake(), ["price_to_ma20", "limit_up"], (1, 5, 20)
    lake.upsert("daily", i.bars)
    lake.upsert("daily_factors", fac.compute_factors(lake.load_ohlcv(), names, bound=i.rows))
    first, last = research.stored_span(lake)
    for day in (first + (last - first) * 2 / 3, last):
        research.update_ic(lake, day, names, lags, give_up_days=(last - first).days)
    return lake.scan("ic_daily").select("time", "lag", "factor_name", "ic", "rank_ic", "n_stocks")


@query
def loaders(i: Inputs) -> DataFrame:
    """Rows and sums of every loader of a stored table, over all of it."""
    lake = i.lake()
    lake.upsert("daily", i.bars)
    first, last = research.stored_span(lake)

    def told(name: str, df: DataFrame, value: str) -> DataFrame:
        return df.agg(F.lit(name).alias("loader"), F.count("*").alias("n_rows"),
                      F.countDistinct("symbol").alias("n_symbols"), F.sum(value).alias("total"))

    parts = [told("returns", lake.load_returns(first, last, 20), "pct_change"),
             told("panel", lake.load_panel(first, last + timedelta(days=1)), "close"),
             told("ohlcv", lake.load_ohlcv(), "close"),
             told("query", lake.query("select symbol, cast(high as double) as high from daily"), "high")]
    return reduce(DataFrame.unionByName, parts)


@query
def stocks_flagged(i: Inputs) -> DataFrame:
    """Stored stocks have no flag of their own: the fill value stands for it."""
    lake = i.lake()
    lake.upsert("stocks", i.stocks)
    return joins.attach_dim(i.raw, lake.load_stocks(), "symbol", {"is_st": 0, "exchange": "?"}).select(
        "time", "symbol", "is_st", "exchange")


@query
def export_files(i: Inputs) -> DataFrame:
    root = i.lake().root
    exported = export.scan_export(i.bars)
    export.write_calendar(exported, f"{root}/calendar")
    export.write_instruments(exported, f"{root}/instruments")
    days = i.spark.read.text(f"{root}/calendar").select(
        F.lit("day").alias("kind"), F.col("value").alias("line"))
    lines = i.spark.read.text(f"{root}/instruments").select(
        F.lit("instrument").alias("kind"), F.translate("value", "\t", " ").alias("line"))
    return days.unionByName(lines)


@query
def retention(i: Inputs) -> DataFrame:
    lake = i.lake()
    lake.upsert("weekly", resample(i.raw, "week"))
    lake.drop_partitions_before("weekly", "1998-01-01")
    return as_double(lake.scan("weekly"))


@query
def weekly_refresh(i: Inputs) -> DataFrame:
    lake = i.lake()
    lake.upsert("daily", i.bars)
    rollups.refresh_window(lake, "week", date(1999, 6, 30), 400, 1)
    return as_double(lake.scan("weekly"))


# -- streaming -------------------------------------------------------------------------------------


def _finish(streaming_query) -> None:
    streaming_query.awaitTermination()


def _bar_stream(i: Inputs, lake: Lake) -> DataFrame:
    """Daily bars landed in vendor form and streamed back in, in two drops.

    The first holds every day but those of every seventh month, and wrong rows for some days: the
    second holds the days left out, so they are late, and the right rows. So keys repeat, and
    the last row landed has to win as a whole.
    """
    landed = f"{lake.root}/landing"
    months = F.year("time") * 12 + F.month("time")
    late, wrong = months % 7 == 0, F.dayofmonth("time") % 5 == 0
    first = i.stored.filter(~late).withColumns({
        "close": F.when(wrong, F.lit(1.0)).otherwise(F.col("close")),
        "pct_change": F.when(~wrong, F.col("pct_change"))})
    landing.to_vendor(first).write.parquet(landed)
    n_first = len(i.spark.read.parquet(landed).inputFiles())
    landing.to_vendor(i.stored.filter(late | wrong)).write.mode("append").parquet(landed)
    n_second = len(i.spark.read.parquet(landed).inputFiles()) - n_first
    # Files are as many as the rows ask for; the first micro-batch ends inside the second drop.
    return ingest.read_landing(i.spark, landed, files_per_batch=n_first + n_second // 4)


@query
def bar_stream(i: Inputs) -> DataFrame:
    lake = i.lake()
    _finish(ingest.stream_bars(_bar_stream(i, lake), lake, f"{lake.root}/checkpoint"))
    return as_double(lake.scan("daily")).select("time", "symbol", "open", "high", "low", "close",
                                                "volume", "amount")


@query
def weekly_stream(i: Inputs) -> DataFrame:
    lake = i.lake()
    bars = landing.normalize_bars(_bar_stream(i, lake))
    _finish(rollups.stream_weekly(bars, lake, f"{lake.root}/checkpoint"))
    return as_double(lake.scan("weekly"))


@query
def monthly_stream(i: Inputs) -> DataFrame:
    lake = i.lake()
    bars = landing.normalize_bars(_bar_stream(i, lake))
    _finish(rollups.stream_monthly(bars, lake, f"{lake.root}/checkpoint"))
    return as_double(lake.scan("monthly"))


@query
def factor_stream(i: Inputs) -> DataFrame:
    lake = i.lake()
    bars = landing.normalize_bars(_bar_stream(i, lake))
    _finish(ingest.stream_factors(bars, lake, f"{lake.root}/checkpoint",
                                  ["price_to_ma20", "ma_cross", "limit_up"]))
    return lake.scan("daily_factors")


def _closed_weeks(i: Inputs) -> Lake:
    """Weekly bars with a watermark of 7 days, from two drops: the second brings every tenth day."""
    lake = i.lake()
    landed, tenth = f"{lake.root}/landing", F.dayofmonth("time") % 10 == 7
    for part in (~tenth, tenth):
        landing.to_vendor(i.stored.filter(part)).write.mode("append").parquet(landed)
        rows = landing.normalize_bars(ingest.read_landing(i.spark, landed))
        _finish(rollups.stream_weekly(rows, lake, f"{lake.root}/checkpoint", watermark=timedelta(days=7)))
    return lake


@query
def weekly_closed_stream(i: Inputs) -> DataFrame:
    return as_double(_closed_weeks(i).scan("weekly"))


@query
def late_bars_stream(i: Inputs) -> DataFrame:
    return as_double(_closed_weeks(i).scan("late_bars"))

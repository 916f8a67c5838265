"""Tables of the lake: schema, key, partitioning and the columns an upsert may change."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE = T.DecimalType(12, 4)
MONEY = T.DecimalType(20, 4)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


@dataclass(frozen=True)
class Table:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    partitions: tuple[str, ...] = ()
    update: tuple[str, ...] = ()
    defaults: tuple[tuple[str, object], ...] = ()

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


def month_of(column: str = "time"):
    """Partition value of a timestamp: ``yyyy-MM``."""
    return F.date_format(column, "yyyy-MM")


_OHLC = dict(open=PRICE, high=PRICE, low=PRICE, close=PRICE)
_TS, _STR, _DBL, _LONG = T.TimestampType(), T.StringType(), T.DoubleType(), T.LongType()

STOCKS = Table(
    "stocks",
    _struct(symbol=_STR, name=_STR, exchange=_STR, sector=_STR, list_date=T.DateType(),
            delist_date=T.DateType(), is_active=T.BooleanType(), updated_at=_TS),
    key=("symbol",),
    update=("name", "exchange", "sector", "list_date", "delist_date", "is_active", "updated_at"),
)
DAILY = Table(
    "daily",
    _struct(time=_TS, symbol=_STR, **_OHLC, volume=_LONG, amount=MONEY,
            adj_factor=T.DecimalType(10, 6), pct_change=T.DecimalType(8, 4),
            is_st=T.BooleanType(), is_suspended=T.BooleanType()),
    key=("time", "symbol"),
    partitions=("ym",),
    update=("open", "high", "low", "close", "volume", "amount", "pct_change"),
    defaults=(("is_st", False), ("is_suspended", False)),
)
MINUTE = Table(
    "minute",
    _struct(time=_TS, symbol=_STR, freq=_STR, **_OHLC, volume=_LONG, amount=MONEY),
    key=("time", "symbol", "freq"),
    partitions=("freq", "ym"),
    update=("open", "high", "low", "close", "volume", "amount"),
    defaults=(("freq", "1m"),),
)
INDEX_DAILY = Table(
    "index_daily",
    _struct(time=_TS, symbol=_STR, name=_STR, **_OHLC, volume=_LONG, amount=MONEY,
            pct_change=T.DecimalType(8, 4)),
    key=("time", "symbol"),
    partitions=("ym",),
    update=("name", "open", "high", "low", "close", "volume", "amount", "pct_change"),
)
FACTORS = Table(
    "daily_factors",
    _struct(time=_TS, symbol=_STR, factor_name=_STR, factor_value=_DBL),
    key=("time", "symbol", "factor_name"),
    partitions=("factor_name", "ym"),
    update=("factor_value",),
)
SIGNALS = Table(
    "trading_signals",
    _struct(time=_TS, symbol=_STR, strategy=_STR, signal=T.ShortType(), score=_DBL, metadata=_STR),
    key=("time", "symbol", "strategy"),
    partitions=("ym",),
    update=("signal", "score", "metadata"),
)
SYNC_STATUS = Table(
    "sync_status",
    _struct(data_type=_STR, symbol=_STR, last_sync_time=_TS, last_date=T.DateType(),
            status=_STR, error_msg=_STR, updated_at=_TS),
    key=("data_type", "symbol"),
    update=("last_sync_time", "last_date", "status", "error_msg", "updated_at"),
)
_ROLLUP = _struct(time=_TS, symbol=_STR, **_OHLC, volume=_LONG, amount=MONEY)
_ROLLUP_UPDATE = ("open", "high", "low", "close", "volume", "amount")
WEEKLY = Table("weekly", _ROLLUP, ("time", "symbol"), ("ym",), _ROLLUP_UPDATE)
MONTHLY = Table("monthly", _ROLLUP, ("time", "symbol"), ("ym",), _ROLLUP_UPDATE)

# State of every factor of a symbol at the end of a month (``time`` is its first day): rows so far, rows of
# the month and a hash of them, the last closes, and the exponentially weighted means.
FACTOR_STATE = Table(
    "factor_state",
    _struct(time=_TS, symbol=_STR, n=_LONG, month_n=_LONG, month_hash=_LONG, closes=T.ArrayType(_DBL),
            avg_gain=_DBL, avg_loss=_DBL, ema_fast=_DBL, ema_slow=_DBL, macd_signal=_DBL),
    key=("time", "symbol"),
    partitions=("ym",),
    update=("n", "month_n", "month_hash", "closes", "avg_gain", "avg_loss", "ema_fast", "ema_slow", "macd_signal"),
)
# Bars that came after the watermark of a rollup.
LATE_BARS = Table(
    "late_bars",
    _struct(view=_STR, time=_TS, symbol=_STR, **_OHLC, volume=_LONG, amount=MONEY),
    key=("view", "time", "symbol"),
    partitions=("view", "ym"),
    update=_ROLLUP_UPDATE,
)
# Daily ICs, with the number of stocks whose return is not known yet.
IC_DAILY = Table(
    "ic_daily",
    _struct(time=_TS, lag=_LONG, factor_name=_STR, ic=_DBL, rank_ic=_DBL, n_stocks=_LONG, n_open=_LONG),
    key=("time", "lag", "factor_name"),
    partitions=("ym",),
    update=("ic", "rank_ic", "n_stocks", "n_open"),
)
# The last finished micro-batch of each stream.
BATCHES = Table(
    "batches",
    _struct(stream=_STR, batch=_LONG, n_rows=_LONG, last_date=T.DateType(), finished_at=_TS),
    key=("stream",),
    update=("batch", "n_rows", "last_date", "finished_at"),
)

TABLES = {t.name: t for t in (STOCKS, DAILY, MINUTE, INDEX_DAILY, FACTORS, SIGNALS, SYNC_STATUS,
                              WEEKLY, MONTHLY, FACTOR_STATE, LATE_BARS, IC_DAILY, BATCHES)}

"""Scalar column builders: codes, dates, rounding and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats and resample units.
VENDOR_DAY = "yyyyMMdd"
ISO_DAY = "yyyy-MM-dd"
UNITS = ("week", "month")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_prefix_code(symbol) -> Column:
    """``000001.SZ`` becomes ``SZ000001``."""
    s = _col(symbol)
    return F.concat(F.split_part(s, F.lit("."), F.lit(2)), F.split_part(s, F.lit("."), F.lit(1)))


def parse_day(text, pattern: str = VENDOR_DAY) -> Column:
    return F.to_timestamp(_col(text), pattern)


def fmt_day(time, pattern: str = VENDOR_DAY) -> Column:
    return F.date_format(_col(time), pattern)


def to_naive_day(time) -> Column:
    """Midnight of the (UTC session) day without a time zone."""
    return F.date_trunc("day", _col(time)).cast("timestamp_ntz")


def shift_days(day, n: int) -> Column:
    return F.date_add(_col(day), n)


def bucket(time, unit: str) -> Column:
    """Start of the week (Monday) or month."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}; one of {', '.join(UNITS)}")
    return F.date_trunc(unit, _col(time))


def round_half_up(c, dp: int) -> Column:
    return F.round(_col(c), dp)


def metadata_to_json(c=None) -> Column:
    """JSON text of a struct or map column; ``{}`` where there is none."""
    return F.lit("{}") if c is None else F.coalesce(F.to_json(_col(c)), F.lit("{}"))


def join_errors(errors, limit: int | None = None) -> Column:
    """Error texts joined by ``"; "``, the first ``limit`` of them if given."""
    e = _col(errors)
    return F.array_join(F.slice(e, 1, limit) if limit else e, "; ")

"""Null and NaN handling. Null is the only missing value in outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c) -> Column:
    """Neither null nor NaN."""
    return _col(c).isNotNull() & ~F.isnan(_col(c))


def finite(c) -> Column:
    """Not null, not NaN, not infinite."""
    return present(c) & (F.abs(_col(c)) < F.lit(float("inf")))


def nan_to(c, value) -> Column:
    """``value`` in place of NaN and of null (``None`` keeps null)."""
    return F.when(present(c), _col(c)).otherwise(F.lit(value))


def null_if_nan(c) -> Column:
    return F.when(~F.isnan(_col(c)), _col(c))


def clean(df: DataFrame, column: str = "factor_value") -> DataFrame:
    """Drop rows whose ``column`` is null or NaN."""
    return df.filter(present(column))


def drop_any_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop rows with a null or NaN in any of ``columns``."""
    return df.filter(reduce(lambda a, b: a & b, [present(c) for c in columns]))

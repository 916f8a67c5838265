"""Aggregate expressions that stay inside partial (map-side) aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits kept of a correlation: an exact zero must not carry the sign of summation noise.
CORR_DIGITS = 12


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation of two null-free columns; null where either has no variance."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.round(F.try_divide(F.covar_pop(x, y), spread), CORR_DIGITS)


def win_rate(c: str) -> Column:
    """Share of positive values among the non-null ones."""
    return F.avg((F.col(c) > 0).cast("double"))


def avg_if(c: str, condition: Column) -> Column:
    """Mean of ``c`` over the rows that meet ``condition``."""
    return F.avg(F.when(condition, F.col(c)))

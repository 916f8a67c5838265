"""How large is the largest group? One number that decides how a window is laid out.

A window runs each of its partitions in one task. That is the cheapest plan while
every partition is of modest size, and a bottleneck when one symbol, day or strategy
holds a large share of the rows. The operators of this package therefore take an
upper bound on the group size, or measure it with one map-side-combined count, and
change to a layout that splits groups when the bound is above ``row_limit``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT_KEY = "factorlake.maxGroupRows"
DEFAULT_LIMIT = 10_000_000


class GroupSizes(NamedTuple):
    total: int
    largest: int


def row_limit(spark: SparkSession) -> int:
    """Most rows one window partition may hold."""
    return int(spark.conf.get(LIMIT_KEY, str(DEFAULT_LIMIT)))


def measure(df: DataFrame, by: list[str]) -> GroupSizes:
    row = (
        df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("total"), F.max("n").alias("largest"))
        .first()
    )
    return GroupSizes(row["total"] or 0, row["largest"] or 0)


def oversized(df: DataFrame, by: list[str], bound: int | None = None,
              limit: int | None = None) -> GroupSizes | None:
    """None if every group of ``by`` may be handled by one task, else the measured sizes."""
    limit = limit or row_limit(df.sparkSession)
    if bound is not None and bound <= limit:
        return None
    sizes = measure(df, by)
    return sizes if sizes.largest > limit else None

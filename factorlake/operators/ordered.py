"""Ordered computations per group: row positions, look-back blocks and running totals.

Each operator has two layouts with equal results:

* groups within the row limit use one plain window partition per group;
* larger groups are range-partitioned by (group, order), so that one group spreads over
  many tasks. Work is done per range and stitched together with a small table that
  has one row per (group, range).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from factorlake.operators.groups import oversized, row_limit
from factorlake.session import durable

POS = "__pos"
RANGE = "__range"
BLOCK = "__block"


@dataclass(frozen=True)
class Series:
    """The window layout handed to column builders: partition columns and order column."""

    by: tuple[str, ...]
    order: str

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.order)

    def last(self, rows: int) -> WindowSpec:
        """The current row and the ``rows - 1`` before it."""
        return self.window.rowsBetween(-(rows - 1), 0)

    def prev(self, c: str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.window)

    def ahead(self, c: str, n: int = 1) -> Column:
        return F.lead(c, n).over(self.window)

    def sma(self, c: str, rows: int) -> Column:
        """Mean of the last ``rows`` values, null until there are that many."""
        frame = self.last(rows)
        return F.when(F.count(c).over(frame) == rows, F.avg(c).over(frame))

    def diff(self, c: str) -> Column:
        return F.col(c) - self.prev(c)


def split_ranges(df: DataFrame, by: list[str], order: str, total: int) -> DataFrame:
    """Range-partition ``total`` rows by (group, order) and number the ranges in ``__range``.

    The result is checkpointed: range bounds come from sampling, so the numbering must
    be stored before two branches of a plan read it.
    """
    parts = max(2, -(-2 * total // row_limit(df.sparkSession)))
    return durable(
        df.repartitionByRange(parts, *by, order).withColumn(RANGE, F.spark_partition_id())
    )


def _carried(ranges: DataFrame, by: list[str], carries: dict[str, Column],
             before: dict[str, Callable[[str], Column]]) -> DataFrame:
    """One row per (group, range): each total of ``carries`` accumulated over earlier ranges."""
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy(*by, RANGE).agg(*[c.alias(n) for n, c in carries.items()])
    return totals.select(*by, RANGE, *[before[n](n).over(earlier).alias(n) for n in carries])


def _row_in(*by: str, order: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long") - 1


def _split_positions(df: DataFrame, by: list[str], order: str, total: int) -> DataFrame:
    ranges = split_ranges(df, by, order, total)
    offset = _carried(ranges, by, {"__offset": F.count(F.lit(1))}, {"__offset": F.sum})
    return (
        ranges.withColumn(POS, _row_in(*by, RANGE, order=order))
        .join(offset, [*by, RANGE])
        .withColumn(POS, F.col(POS) + F.coalesce("__offset", F.lit(0)))
        .drop("__offset", RANGE)
    )


def positions(df: DataFrame, by: list[str], order: str, bound: int | None = None) -> DataFrame:
    """Add ``__pos``, the 0-based position of each row in its group."""
    sizes = oversized(df, by, bound)
    if sizes is None:
        return df.withColumn(POS, _row_in(*by, order=order))
    return _split_positions(df, by, order, sizes.total)


def over_series(df: DataFrame, add: Callable[[DataFrame, Series], DataFrame], *,
                by: list[str], order: str, before: int = 0, after: int = 0,
                bound: int | None = None, limit: int | None = None) -> DataFrame:
    """Add columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``add`` gets the rows with ``__pos`` and the layout to build its windows from, and may
    only add columns. Groups above the row limit are cut into blocks of consecutive rows;
    each block carries copies of the rows its windows reach for, which are dropped again.
    ``limit`` replaces the row limit of the session.
    """
    limit = limit or row_limit(df.sparkSession)
    sizes = oversized(df, by, bound, limit)
    if sizes is None:
        placed = df.withColumn(POS, _row_in(*by, order=order))
        return add(placed, Series(tuple(by), order)).drop(POS)
    size = max(limit, before, after, 1)
    block, inside = F.floor(F.col(POS) / size), F.col(POS) % size
    copies = F.array_compact(F.array(
        block,
        F.when(inside >= size - before, block + 1),
        F.when((inside < after) & (block > 0), block - 1),
    ))
    blocks = _split_positions(df, by, order, sizes.total).withColumn(BLOCK, F.explode(copies))
    added = add(blocks, Series((*by, BLOCK), order))
    return added.filter(F.col(BLOCK) == F.floor(F.col(POS) / size)).drop(POS, BLOCK)


@dataclass(frozen=True)
class Running:
    """A running ``sum``, ``product``, ``max`` or ``last`` non-null value of an expression."""

    name: str
    kind: str
    value: Column

    def aggregate(self, c) -> Column:
        """Over the rows of an ordered window."""
        if self.kind == "last":
            return F.last(c, ignorenulls=True)
        return {"sum": F.sum, "product": F.product, "max": F.max}[self.kind](c)

    def total(self, order: str) -> Column:
        """Over all rows of a range, in whatever order they come."""
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), F.col(order)))
        return self.aggregate(self.value)

    def combine(self, local: Column, carried: Column) -> Column:
        if self.kind == "max":
            return F.greatest(local, carried)
        if self.kind == "last":
            return F.coalesce(local, carried)
        if self.kind == "sum":
            return local + F.coalesce(carried, F.lit(0))
        return local * F.coalesce(carried, F.lit(1.0))


def cumulative(df: DataFrame, by: list[str], order: str, steps: list[Running],
               bound: int | None = None) -> DataFrame:
    """Add running aggregates; a step may use the columns of the steps before it."""
    sizes = oversized(df, by, bound)
    if sizes is None:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        for step in steps:
            df = df.withColumn(step.name, step.aggregate(step.value).over(w))
        return df
    rows = split_ranges(df, by, order, sizes.total)
    local = Window.partitionBy(*by, RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for step in steps:
        carry = f"__carry_{step.name}"
        carried = _carried(rows, by, {carry: step.total(order)}, {carry: step.aggregate})
        rows = (
            rows.withColumn(step.name, step.aggregate(step.value).over(local))
            .join(carried, [*by, RANGE])
            .withColumn(step.name, step.combine(F.col(step.name), F.col(carry)))
            .drop(carry)
        )
    return rows.drop(RANGE)

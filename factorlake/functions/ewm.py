"""Exponentially weighted means as window sums.

``y[t] = a*x[t] + (1-a)*y[t-1]`` seeded with ``y[seed] = x[seed]`` unrolls to
``sum((1-a)^(t-i) * w[i] * x[i])``. Positions are cut into segments; the sum inside a segment is a
running sum of ``(1-a)^-j * w * x``, and earlier segments enter through their closing
values. A segment is short enough that the fastest mean of a call does not overflow, and
as many closing values are taken as the slowest one remembers at double precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorlake.operators.ordered import POS, RANGE, Series, split_ranges
from factorlake.session import durable

# Decimal digits that the weights inside a segment may span, and what double precision forgets.
DIGITS = 200.0
FORGOTTEN = 40.0
# Rows after which the means of the default factors no longer depend on what came before.
MEMORY = 1024
_SEG = "__segment"
# Columns of a series that goes on from a stored state: is the row one kept from before, how many of these
# rows there are, how many rows the state covers, and the value of each mean at the last of them.
OLD, TAIL, COUNT = "__old", "__tail", "__count"


def carry(name: str) -> str:
    return f"__carry_{name}"


def so_far(name: str) -> str:
    """The mean of a row, whether or not it has the periods to be shown."""
    return f"__y_{name}"


def place(resumed: bool) -> Column:
    """0-based position of a row in its whole series."""
    return F.col(POS) - F.col(TAIL) + F.col(COUNT) if resumed else F.col(POS)


@dataclass(frozen=True)
class Ewm:
    """EWM of ``source``, seeded at row ``seed`` and null for ``min_periods - 1`` rows after it."""

    name: str
    source: str
    alpha: float
    seed: int = 0
    min_periods: int = 1

    def __post_init__(self):
        if not 0 < self.alpha <= 1:
            raise ValueError(f"alpha {self.alpha} is not in (0, 1]")

    @property
    def keep(self) -> float:
        """What is kept of the mean so far, with a floor that stands for nothing."""
        return max(1 - self.alpha, 1e-30)

    @property
    def memory(self) -> int:
        """Rows after which a value no longer matters."""
        return math.ceil(FORGOTTEN / -math.log(self.keep))


def add_ewms(df: DataFrame, series: Series, specs: list[Ewm], resumed: bool = False) -> DataFrame:
    """Add the columns of ``specs``; the sources must have no null from their seed on.

    A ``resumed`` series starts with rows of its state: they feed no mean, whose value at the last of
    them is carried on instead. It also gets the ``so_far`` columns, to go on from later.
    """
    kept = df.columns
    at = place(resumed)
    segment_rows = min(max(1, int(DIGITS / -math.log10(s.keep))) for s in specs)
    inside = F.col(POS) % segment_rows
    running = (
        Window.partitionBy(*series.by, _SEG).orderBy(series.order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )

    def local(s: Ewm) -> Column:
        keep = F.lit(s.keep)
        weight = F.when(at > s.seed, s.alpha).when(at == s.seed, 1.0)
        if resumed:
            weight = F.when(~F.col(OLD), weight)
        term = F.coalesce(weight * F.col(s.source), F.lit(0.0)) * F.pow(keep, -inside)
        return F.pow(keep, inside) * F.sum(term).over(running)

    def closing(s: Ewm, back: int) -> Column:
        segment = Window.partitionBy(*series.by).orderBy(_SEG).rangeBetween(-back, -back)
        last = F.when(inside == segment_rows - 1, F.col(f"__local_{s.name}"))
        return F.coalesce(F.sum(last).over(segment), F.lit(0.0))

    backs = {s.name: range(1, -(-s.memory // segment_rows) + 1) for s in specs}
    df = df.withColumn(_SEG, F.floor(F.col(POS) / segment_rows))
    df = df.select("*", *[local(s).alias(f"__local_{s.name}") for s in specs])
    df = df.select("*", *[closing(s, b).alias(f"__close{b}_{s.name}") for s in specs for b in backs[s.name]])

    def value(s: Ewm) -> Column:
        carried = sum(F.col(f"__close{b}_{s.name}") * F.lit(s.keep ** (segment_rows * (b - 1)))
                      for b in backs[s.name])
        y = F.col(f"__local_{s.name}") + carried * F.pow(F.lit(s.keep), inside + 1)
        if not resumed:
            return y
        since = F.pow(F.lit(s.keep), F.greatest(at - F.col(COUNT) + 1, F.lit(0)))
        return F.when(at >= s.seed, y + F.coalesce(F.col(carry(s.name)), F.lit(0.0)) * since)

    def shown(s: Ewm) -> Column:
        return F.when(at >= s.seed + s.min_periods - 1, F.col(so_far(s.name))).alias(s.name)

    df = df.select(*kept, *[value(s).alias(so_far(s.name)) for s in specs])
    return df.select(*kept, *[shown(s) for s in specs], *[so_far(s.name) for s in specs if resumed])


def range_ewms(df: DataFrame, by: list[str], order: str, specs: list[Ewm], total: int) -> DataFrame:
    """The columns of ``specs`` for groups too large for one task, for any weight and without copied rows.

    ``total`` rows are split into ranges of (group, order). What a range does to a mean is an affine map
    y -> a*y + b: a is what is left of the mean after its rows, b the mean of its rows alone. The maps of
    earlier ranges are composed by a parallel prefix over a table of one row per (group, range), in as many
    steps as the number of ranges has binary digits, and give the mean that a range goes on from.
    """
    kept = df.columns
    rows = split_ranges(df, by, order, total)
    sizes = durable(rows.groupBy(*by, RANGE).agg(F.count("*").alias("__rows")))
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, RANGE, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias(COUNT))
    inside = Window.partitionBy(*by, RANGE).orderBy(order)
    placed = rows.withColumn(POS, F.row_number().over(inside).cast("long") - 1).join(offsets, [*by, RANGE]).withColumns(
        {TAIL: F.lit(0).cast("long"), OLD: F.lit(False), **{carry(s.name): F.lit(None).cast("double") for s in specs}})
    local = add_ewms(placed, Series((*by, RANGE), order), specs, resumed=True)

    alone = [F.coalesce(F.max_by(so_far(s.name), POS), F.lit(0.0)).alias(f"__b_{s.name}") for s in specs]
    maps = local.groupBy(*by, RANGE).agg(F.count("*").alias("__rows"), *alone).select(
        *by, RANGE, *[f"__b_{s.name}" for s in specs],
        *[F.pow(F.lit(s.keep), F.col("__rows")).alias(f"__a_{s.name}") for s in specs])
    maps = durable(maps)
    most = sizes.groupBy(*by).count().agg(F.max("count").alias("n")).first()["n"] or 1
    across, step = Window.partitionBy(*by).orderBy(RANGE), 1
    while step < most:
        # The map of twice as many ranges: first that of the ranges further back, then one's own.
        def back(c: str, none: float, step: int = step) -> Column:
            return F.coalesce(F.lag(c, step).over(across), F.lit(none))

        maps = maps.select(*by, RANGE, *[c for s in specs for c in (
            (F.col(f"__a_{s.name}") * back(f"__a_{s.name}", 1.0)).alias(f"__a_{s.name}"),
            (F.col(f"__b_{s.name}") + F.col(f"__a_{s.name}") * back(f"__b_{s.name}", 0.0)).alias(f"__b_{s.name}"))])
        step *= 2
    before = maps.select(*by, RANGE, *[F.coalesce(F.lag(f"__b_{s.name}", 1).over(across), F.lit(0.0)).alias(
        f"__in_{s.name}") for s in specs])

    def value(s: Ewm) -> Column:
        y = F.col(so_far(s.name)) + F.col(f"__in_{s.name}") * F.pow(F.lit(s.keep), F.col(POS) + 1)
        return F.when(place(True) >= s.seed + s.min_periods - 1, y).alias(s.name)

    return local.join(before, [*by, RANGE]).select(*kept, *[value(s) for s in specs])

"""Ranks inside a cross-section, rank correlation, top-k and exact median."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorlake.functions.stats import safe_corr
from factorlake.operators.groups import oversized
from factorlake.operators.ordered import Running, cumulative
from factorlake.session import durable


def avg_rank(c: str, by: list[str]) -> Column:
    """1-based rank among the non-null values of the group; ties share their mean rank."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(c))
    return F.when(F.col(c).isNotNull(), (F.rank().over(w) + F.count(c).over(w)) / F.lit(2.0))


def with_avg_ranks(df: DataFrame, by: list[str], columns: dict[str, str],
                   bound: int | None = None) -> DataFrame:
    """Add ``{new: source}`` average ranks; null values stay out and get no rank.

    Beyond the row limit the rank comes from value counts: copies of a value combine before
    the shuffle, running counts are taken per value range, and the rank joins back by value.
    """
    if oversized(df, by, bound) is None:
        return df.select("*", *[avg_rank(c, by).alias(n) for n, c in columns.items()])
    for new, source in columns.items():
        df = _ranks_by_value(df, by, source, {new: F.lit(1)})
    return df


def _ranks_by_value(df: DataFrame, by: list[str], source: str,
                    weights: dict[str, Column]) -> DataFrame:
    counts = df.filter(F.col(source).isNotNull()).groupBy(*by, source).agg(
        *[F.sum(m).alias(f"__n_{n}") for n, m in weights.items()])
    steps = [Running(f"__upto_{n}", "sum", F.col(f"__n_{n}")) for n in weights]
    ranks = cumulative(counts, by, source, steps).select(*by, source, *[
        (F.col(f"__upto_{n}") - (F.col(f"__n_{n}") - 1) / F.lit(2.0)).alias(n) for n in weights])
    return df.join(ranks, [*by, source], "left")


def with_masked_ranks(df: DataFrame, by: list[str], source: str, masks: dict[str, Column],
                      bound: int | None = None) -> DataFrame:
    """Add, per ``{new: mask}``, the average rank of ``source`` among the rows of that mask.

    One ordering serves every mask: with ``n`` mask rows up to a value and ``m`` at it, the
    rank is ``n - (m - 1) / 2``. Rows without a value count nowhere and have no rank; ranks of
    rows outside the mask mean nothing.
    """
    there = F.col(source).isNotNull()
    inside = {n: (m & there).cast("int") for n, m in masks.items()}
    if oversized(df, by, bound) is None:
        w = Window.partitionBy(*by).orderBy(source)
        upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        here = w.rangeBetween(Window.currentRow, Window.currentRow)
        return df.select("*", *[
            F.when(there, F.sum(m).over(upto) - (F.sum(m).over(here) - 1) / F.lit(2.0)).alias(n)
            for n, m in inside.items()])
    return _ranks_by_value(df, by, source, inside)


def rank_corr(df: DataFrame, by: list[str], x: str, y: str, bound: int | None = None) -> DataFrame:
    """Per group: Pearson ``ic``, Spearman ``rank_ic`` and the row count of null-free pairs."""
    ranked = with_avg_ranks(df, by, {"__rx": x, "__ry": y}, bound)
    return ranked.groupBy(*by).agg(
        safe_corr(x, y).alias("ic"),
        safe_corr("__rx", "__ry").alias("rank_ic"),
        F.count(F.lit(1)).alias("n_stocks"),
    )


def top_k(df: DataFrame, by: list[str], score: str, k: int, tie: str = "symbol") -> DataFrame:
    """The ``k`` best rows per group, ties by ``tie``.

    Spark keeps at most ``k`` rows per group and task before the shuffle, so a large group
    never reaches one task whole.
    """
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def value_counts(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """How often each value, null included, stands in each group: ``__n``."""
    return df.groupBy(*by, c).agg(F.count(F.lit(1)).alias("__n"))


def exact_median(df: DataFrame, by: list[str], c: str, bound: int | None = None) -> DataFrame:
    """Exact (interpolated) ``median`` per group from combined value counts."""
    counts = value_counts(df.filter(F.col(c).isNotNull()), by, c)
    if bound is None:
        # Read several times below, and smaller than the rows it came from.
        counts = durable(counts)
    return median_of(counts, by, c, bound)


def median_of(counts: DataFrame, by: list[str], c: str, bound: int | None = None) -> DataFrame:
    """``median`` per group from the counts of its values."""
    counts = counts.filter(F.col(c).isNotNull())
    upto = cumulative(counts, by, c, [Running("__upto", "sum", F.col("__n"))], bound)
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))

    def holds(index: Column) -> Column:
        return (F.col("__upto") > index) & (F.col("__upto") - F.col("__n") <= index)

    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    return (
        upto.join(totals, by)
        .groupBy(*by)
        .agg((F.max(F.when(holds(low), F.col(c))) / 2
              + F.max(F.when(holds(high), F.col(c))) / 2).alias("median"))
    )

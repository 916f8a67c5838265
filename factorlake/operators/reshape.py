"""Between wide and long factor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.functions.missing import clean

ID = ["time", "symbol"]


def require(available, names: list[str]) -> None:
    """Raise if one of ``names`` is not in ``available`` (a DataFrame or a list of names)."""
    have = available.columns if isinstance(available, DataFrame) else list(available)
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"missing {', '.join(missing)}; available: {', '.join(have)}")


def missing_factors(long: DataFrame, names: list[str]) -> DataFrame:
    """factor_name: those of ``names`` without a row in a long table. Names found combine before the shuffle."""
    wanted = long.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "factor_name string")
    return wanted.join(long.select("factor_name").distinct(), "factor_name", "left_anti")


def to_long(wide: DataFrame, factors: list[str]) -> DataFrame:
    """One row per (time, symbol, factor) that has a value: a single expand, no shuffle."""
    long = wide.unpivot(ID, factors, "factor_name", "factor_value")
    return clean(long).select(*ID, "factor_name", "factor_value")


def to_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One column per name; the list is given, so no job looks for the distinct names.

    Two rows of one (time, symbol, factor) are an error when the result is computed.
    """

    def only(name: str) -> Column:
        mine = F.col("factor_name") == name
        return F.when(F.count_if(mine) > 1, F.raise_error(F.lit(f"repeated key for factor {name}")).cast("double")
                      ).otherwise(F.first(F.when(mine, F.col("factor_value")), True)).alias(name)

    return long.filter(F.col("factor_name").isin(names)).groupBy(*ID).agg(*map(only, names))


def require_factors(long: DataFrame, names: list[str]) -> None:
    """Raise if one of ``names`` has no row: one small aggregate over the name column."""
    found = long.filter(F.col("factor_name").isin(names)).select("factor_name").distinct().collect()
    require([r["factor_name"] for r in found], names)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

"""Tables of an external database over JDBC, read and written in parallel."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession


def month_ranges(start: date, end: date, column: str = "time") -> list[str]:
    """Predicates that cut the half-open range into calendar months."""
    ranges, lo = [], start
    while lo < end:
        hi = min(end, date(lo.year + lo.month // 12, lo.month % 12 + 1, 1))
        ranges.append(f"{column} >= '{lo} 00:00:00' AND {column} < '{hi} 00:00:00'")
        lo = hi
    return ranges


def read_table(spark: SparkSession, url: str, table: str, start: date, end: date,
               column: str = "time", **properties: str) -> DataFrame:
    """Rows of the half-open time range, one task and one range query per month.

    ``table`` may be a parenthesised query with an alias. Filters and column choice made on
    the result are sent to the database as well.
    """
    return spark.read.jdbc(url, table, predicates=month_ranges(start, end, column),
                           properties=properties)


def write_table(df: DataFrame, url: str, table: str, connections: int = 8, mode: str = "append",
                **properties: str) -> None:
    """Write through ``connections`` connections; the tasks before the write keep their number."""
    df.repartition(connections).write.jdbc(url, table, mode=mode, properties=properties)

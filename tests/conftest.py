from __future__ import annotations

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factorlake import build_session
from factorlake.operators.groups import LIMIT_KEY


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_limit(spark):
    """Every group above 40 rows is split."""
    spark.conf.set(LIMIT_KEY, "40")
    yield 40
    spark.conf.unset(LIMIT_KEY)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars of symbols from lists of closes; open, high and low equal the close."""

    def build(closes: dict[str, list], start="2024-01-01", **extra):
        first = datetime.fromisoformat(start)
        rows = [(first + timedelta(days=k), s, c) for s, cs in closes.items() for k, c in enumerate(cs)]
        bars = spark.createDataFrame(rows, "time timestamp, symbol string, close double")
        for name in ("open", "high", "low"):
            bars = bars.withColumn(name, F.col("close"))
        return bars.withColumn("volume", F.lit(100).cast("long")).withColumn(
            "amount", F.col("close") * 100)

    return build


def rows_of(df, *columns):
    """Sorted plain tuples, doubles rounded."""
    def plain(v):
        return round(v, 9) if isinstance(v, float) else v

    picked = df.select(*columns) if columns else df.select(*sorted(df.columns))
    return sorted((tuple(plain(v) for v in r) for r in picked.collect()), key=repr)

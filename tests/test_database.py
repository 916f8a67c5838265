from datetime import date

import pytest
from conftest import rows_of

from factorlake.sources.database import month_ranges, read_table, write_table

DERBY = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_month_ranges_cover_without_overlap():
    assert month_ranges(date(2023, 11, 15), date(2024, 1, 10), "t") == [
        "t >= '2023-11-15 00:00:00' AND t < '2023-12-01 00:00:00'",
        "t >= '2023-12-01 00:00:00' AND t < '2024-01-01 00:00:00'",
        "t >= '2024-01-01 00:00:00' AND t < '2024-01-10 00:00:00'"]
    assert month_ranges(date(2024, 1, 1), date(2024, 1, 1)) == []


def test_round_trip_through_a_database(spark, make_bars, folder):
    bars = make_bars({"a": [float(k) for k in range(70)], "b": [1.0] * 5}).withColumnRenamed("time", "day")
    url = f"jdbc:derby:{folder}/db;create=true"
    try:
        write_table(bars, url, "bars", 2, "overwrite", **DERBY)
    except Exception as error:
        if "ClassNotFound" in str(error) or "No suitable driver" in str(error):
            pytest.skip("no embedded database on the class path")
        raise
    got = read_table(spark, url, "bars", date(2024, 1, 1), date(2024, 3, 20), '"day"', **DERBY)
    assert got.rdd.getNumPartitions() == 3
    assert rows_of(got) == rows_of(bars)

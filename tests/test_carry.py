"""Runs that go on from stored states against runs over all bars."""

from datetime import date

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from factorlake.plans import carry
from factorlake.plans.factors import DEFAULT_NAMES, compute_factors
from factorlake.plans.incremental import update_factors
from factorlake.sources.lake import Lake, as_double

NAMES = [*DEFAULT_NAMES, "ma60", "macd"]


@pytest.fixture
def bars(make_bars):
    """Symbols of many and few rows, one that pauses for months and one that starts late."""
    whole = make_bars({s: [float(40 + (k * n) % 19) + k / 7 for k in range(300)] for n, s in enumerate("abcd", 5)})
    pause = (F.col("symbol") == "c") & F.col("time").between("2024-03-20", "2024-07-05")
    late = (F.col("symbol") == "d") & (F.col("time") < "2024-09-15")
    return whole.filter(~pause & ~late)


def stored(lake):
    return as_double(lake.scan("daily")).select("time", "symbol", "open", "high", "low", "close", "volume")


@pytest.mark.parametrize("month", ["2024-02", "2024-03", "2024-08", "2024-10"])
def test_replay_goes_on_bit_for_bit(spark, bars, folder, month):
    lake = Lake(spark, f"{folder}/lake")
    lake.upsert("daily", bars)
    first = date.fromisoformat(f"{month}-01")
    rows, _, _ = carry.carried_factors(lake, first, None, NAMES)
    got = carry.long_factors(rows, NAMES)
    want = compute_factors(stored(lake), NAMES).filter(F.col("time") >= F.lit(first))
    assert rows_of(got.withColumn("factor_value", F.round("factor_value", 12))) == rows_of(
        want.withColumn("factor_value", F.round("factor_value", 12)))
    assert lake.months("factor_state")[-1] < month


def test_replay_in_split_layout(spark, bars, folder, tiny_limit):
    lake = Lake(spark, f"{folder}/lake")
    lake.upsert("daily", bars)
    rows, _, _ = carry.carried_factors(lake, date(2024, 4, 1), None, NAMES)
    want = compute_factors(stored(lake), NAMES).filter("time >= '2024-04-01'")
    assert rows_of(carry.long_factors(rows, NAMES)) == rows_of(want)


def test_states_follow_their_bars(spark, bars, folder):
    lake = Lake(spark, f"{folder}/lake")
    lake.upsert("daily", bars)
    carry.base_state(lake, date(2024, 6, 1))
    assert lake.months("factor_state") == ["2024-01", "2024-02", "2024-03", "2024-04", "2024-05"]
    # A symbol has a state for every month since its first bar, also without bars in it.
    assert lake.scan("factor_state").filter("symbol = 'c'").count() == 5
    assert lake.scan("factor_state").filter("symbol = 'd'").count() == 0
    assert carry.verified(lake, "2024-05")
    # New bars drop the states of their month and later ones.
    day = bars.filter("time = '2024-03-05'").withColumn("close", F.lit(1.0))
    lake.upsert("daily", day)
    assert lake.months("factor_state") == ["2024-01", "2024-02"]
    carry.base_state(lake, date(2024, 6, 1))
    # Bars that came by another way are told by their hash.
    lake.upsert("daily", day.withColumn("close", F.lit(2.0)), keep_states=True)
    assert not carry.verified(lake, "2024-03") and carry.verified(lake, "2024-02")


def test_update_factors_reads_the_months_it_needs(spark, bars, folder, monkeypatch):
    lake = Lake(spark, f"{folder}/lake")
    lake.upsert("daily", bars)
    update_factors(lake, date(2024, 9, 30), 400, names=NAMES)
    scans, scan = [], lake.scan

    def counted(name, *args, **kw):
        df = scan(name, *args, **kw)
        if name == "daily":
            scans.append({r[0].split("ym=")[1][:7] for r in df.select(F.input_file_name()).distinct().collect()})
        return df

    monkeypatch.setattr(lake, "scan", counted)
    update_factors(lake, date(2024, 10, 3), 7, names=NAMES)
    scans.clear()
    update_factors(lake, date(2024, 10, 5), 3, names=NAMES)
    assert set().union(*scans) == {"2024-09", "2024-10"}
    want = compute_factors(stored(lake).filter("time < '2024-10-06'"), NAMES)
    assert rows_of(lake.scan("daily_factors")) == rows_of(want)


def test_nothing_stored(spark, folder):
    lake = Lake(spark, f"{folder}/lake")
    assert carry.base_state(lake, date(2024, 6, 1)) == (None, None)

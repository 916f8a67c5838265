"""The registered queries have SQL of the same name, and a sample of them agrees with it."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from check_oracle import compare, connect  # noqa: E402
from factorlake.catalogue.oracle import ORACLE  # noqa: E402
from factorlake.catalogue.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["bars_daily", "bars_weekly", "factors_long", "daily_ic_lag1", "ic_decay", "group_stats",
          "ret_hist", "momentum_from_long", "compare_metrics", "topk_backtest", "dense_arrays",
          "upsert_bars", "sync_status", "minute_15m_from_5m"]


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_of_the_library_has_sql():
    assert sorted(QUERIES) == sorted(ORACLE)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    assert compare(spark, db, SF, name).startswith("ok")


def test_entry_has_rows_and_a_stable_schema(spark):
    first, second = entry(spark), entry(spark)
    assert first.schema == second.schema and first.count() == 25

"""Continuous ingest of landed bars and of the factors of the days they touch.

A micro-batch that is run again upserts the same rows by key, and not at all once it is in the ledger.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factorlake.plans.carry import carried_factors, long_factors, states
from factorlake.session import durable
from factorlake.sources.lake import Lake
from factorlake.sources.landing import LANDING_SCHEMA, ingest_order, normalize_bars, with_ingest
from factorlake.streaming.ledger import Ledger
from factorlake.streaming.rollups import _start


def read_landing(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(LANDING_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_ingest(reader.parquet(path))


def stream_bars(landed: DataFrame, lake: Lake, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Normalise landed rows and upsert them into the daily table.

    Of rows with one key in a micro-batch the last one landed wins as a whole. A micro-batch counts once: its
    rows, last day and status stay as they were if it is run again.
    """
    return _start(normalize_bars(landed), checkpoint, once,
                  lambda rows, _: lake.upsert("daily", rows, ingest_order(rows)), mode="append",
                  ledger=Ledger(lake, checkpoint, "daily"))


def stream_factors(bars: DataFrame, lake: Lake, checkpoint: str, names: list[str] | None = None,
                   once: bool = True) -> StreamingQuery:
    """Upsert arriving bars and the factors that depend on them.

    An average looks back, so a bar that arrives late changes the factors of its day and of all
    later days of its symbol. Each touched symbol goes on from its state at the end of the month before its
    batch's earliest bar and is stored from its own earliest bar on: arrival in any order gives the factors of a full
    run. A batch of current bars reads their month and the one before, which its state is verified by.
    """

    def refresh(rows: DataFrame, _: int) -> int:
        with lake.staged(rows) as rows:
            n = lake.upsert("daily", rows, ingest_order(rows), keep_states=True, staged=True)
            if not n:
                return 0
            since = rows.groupBy("symbol").agg(F.min("time").alias("__since"))
            first = rows.agg(F.min("time").cast("date").alias("d")).first()["d"]
            stale = [m for m in lake.months("factor_state") if m >= str(first)[:7]]
            computed, stored, state = carried_factors(lake, first, None, names, since, ends=bool(stale))
            if stale:
                computed = durable(computed)  # read for the factors and for the states
            lake.upsert("daily_factors", long_factors(computed.filter("time >= __since"), names))
            if stale:
                # States that the batch came too late for, of the symbols it touches.
                again = [date.fromisoformat(f"{m}-01") for m in (str(first)[:7], stale[-1])]
                lake.upsert("factor_state", states(computed, stored, state, *again))
            return n

    return _start(bars, checkpoint, once, refresh, mode="append", ledger=Ledger(lake, checkpoint, "factors"))

"""One status row per task."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.functions.scalars import join_errors
from factorlake.sources.lake import Lake

# Status texts.
OK, ERROR = "ok", "error"


def status_row(spark: SparkSession, data_type: str, last_date, errors: list[str] | None = None,
               error_limit: int | None = None, as_of: datetime | None = None) -> DataFrame:
    """The status of a task run at ``as_of``, with its (first ``error_limit``) errors joined."""
    now = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
    errors = errors or []
    row = spark.createDataFrame(
        [(data_type, None, now, last_date, ERROR if errors else OK, errors, now)],
        "data_type string, symbol string, last_sync_time timestamp, last_date date, "
        "status string, errors array<string>, updated_at timestamp",
    )
    text = F.when(F.size("errors") > 0, join_errors("errors", error_limit))
    return row.withColumn("error_msg", text).drop("errors")


def record_sync(lake: Lake, data_type: str, last_date, errors: list[str] | None = None,
                error_limit: int | None = None, as_of: datetime | None = None) -> None:
    """Insert or replace the row of ``data_type``."""
    lake.upsert("sync_status",
                status_row(lake.spark, data_type, last_date, errors, error_limit, as_of))


class PartialRun(RuntimeError):
    """A run that stored what it could; its status row names what failed."""

    def __init__(self, stored: int, errors: list[str]):
        super().__init__(f"{stored} rows stored; " + "; ".join(errors))
        self.stored, self.errors = stored, errors


@contextmanager
def reported(lake: Lake, data_type: str, as_of: datetime | None = None) -> Iterator[None]:
    """Leave an error status of ``data_type`` if the work inside raises; its last day stays."""
    try:
        yield
    except PartialRun:
        raise
    except Exception as error:
        known = lake.scan("sync_status").filter(F.col("data_type") == data_type).select("last_date").first()
        text = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
        record_sync(lake, data_type, known["last_date"] if known else None, [text], as_of=as_of)
        raise

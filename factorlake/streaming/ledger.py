"""Which micro-batch of a stream was finished last, so that one that is run again has no second effect."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.sources.lake import Lake
from factorlake.sources.status import record_sync


@dataclass(frozen=True)
class Ledger:
    """One row per stream (named by its checkpoint) in the table ``batches``; ``task`` names its status row.

    A stream runs its batches in order and repeats at most the last one. The row is written after the
    batch's own tables and before its status. A batch that broke off before that is upserted again by key; one
    that broke off after it only writes its status again, with the counts and the time of the first run.
    """

    lake: Lake
    stream: str
    task: str

    def finished(self) -> dict | None:
        row = self.lake.scan("batches").filter(F.col("stream") == self.stream).first()
        return row.asDict() if row else None

    def once(self, write: Callable[[DataFrame, int], int], rows: DataFrame, batch: int) -> None:
        done = self.finished()
        if done is None or done["batch"] < batch:
            last = rows.agg(F.max("time").cast("date").alias("d")).first()["d"]
            n = write(rows, batch)
            done = {"n_rows": n, "last_date": last or (done and done["last_date"]),
                    "finished_at": datetime.now(timezone.utc).replace(tzinfo=None)}
            self._note(batch, done["n_rows"], done["last_date"], done["finished_at"])
        if done["last_date"] is not None:
            record_sync(self.lake, self.task, done["last_date"], as_of=done["finished_at"])

    def _note(self, batch: int, n_rows: int, last: date | None, at: datetime) -> None:
        row = self.lake.spark.createDataFrame(
            [(self.stream, batch, n_rows, last, at)],
            "stream string, batch long, n_rows long, last_date date, finished_at timestamp")
        self.lake.upsert("batches", row)

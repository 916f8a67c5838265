"""Parquet tables under one root folder: scans, upserts, retention and catalog entries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import replace
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlake.operators.columns import in_range, in_universe
from factorlake.schemas import TABLES, Table, month_of
from factorlake.session import delete, tidy
from factorlake.sources.upsert import merge_table

Day = str | date | datetime
# Rows of one partition that are merged and written by one task.
SLOT_ROWS = 250_000
SLOT, ORDER = "__slot", "__order"
# Partition values of a batch that are listed on the driver.
MAX_LISTED = 10_000
# Symbols a Bloom filter of a row group is sized for, and rows of a page.
SYMBOLS, PAGE_ROWS = 10_000, 4_096


def as_double(df: DataFrame) -> DataFrame:
    """The analytics view of a table: decimals as doubles."""
    decimals = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals}) if decimals else df


class Lake:
    """Tables of ``schemas.TABLES`` below ``root``, a folder every executor can reach.

    One writer per table at a time. An upsert rewrites only the partitions its batch
    touches. Spark writes the merged rows to a staging folder and moves whole partitions from there once all
    tasks are done, so a lost executor or driver never leaves a half-read input, and
    running the same batch again gives the same table. Tables without partitions get a staging folder here.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _stored(self, table: Table) -> T.StructType:
        known = set(table.columns)
        extra = [T.StructField(p, T.StringType()) for p in table.partitions if p not in known]
        return T.StructType([*table.schema.fields, *extra])

    def _read(self, table: Table, path: str | None = None) -> DataFrame:
        path = path or self.path(table.name)
        if not self._exists(path):
            return self.spark.createDataFrame([], self._stored(table))
        return self.spark.read.schema(self._stored(table)).parquet(path)

    # -- scans ---------------------------------------------------------------------------

    def scan(self, name: str, start: Day | None = None, end: Day | None = None,
             closed: str = "both", **members) -> DataFrame:
        """Rows in the time range and, per keyword, with the column among the given values.

        The month partition is constrained along with ``time``, so files outside the range
        are never listed into the scan.
        """
        table = TABLES[name]
        df = self._read(table)
        if "ym" in table.partitions:
            if start is not None:
                df = df.filter(F.col("ym") >= str(start)[:7])
            if end is not None:
                df = df.filter(F.col("ym") <= str(end)[:7])
        df = in_range(df, "time", start, end, closed) if "time" in table.columns else df
        for column, values in members.items():
            df = in_universe(df, column, values)
        return df.select(*table.columns)

    def load_ohlcv(self, start: Day | None = None, end: Day | None = None,
                   symbols: list[str] | None = None) -> DataFrame:
        bars = as_double(self.scan("daily", start, end, symbol=symbols))
        return bars.select("time", "symbol", "open", "high", "low", "close", "volume")

    def load_panel(self, start: Day, end_excl: Day) -> DataFrame:
        bars = as_double(self.scan("daily", start, end_excl, closed="left"))
        return bars.select("time", "symbol", "open", "high", "low", "close", "pct_change")

    def load_factors(self, start: Day | None = None, end: Day | None = None,
                     names: list[str] | None = None) -> DataFrame:
        return self.scan("daily_factors", start, end, factor_name=names)

    def load_returns(self, start: date, end: date, max_lag: int) -> DataFrame:
        """Returns up to ``2 * max_lag + 5`` days past the end, for the forward returns."""
        padded = end + timedelta(days=2 * max_lag + 5)
        return as_double(self.scan("daily", start, padded)).select("time", "symbol", "pct_change")

    def load_stocks(self) -> DataFrame:
        return self.scan("stocks")

    def load_index(self, symbol: str, start: Day | None = None, end: Day | None = None) -> DataFrame:
        return as_double(self.scan("index_daily", start, end, symbol=[symbol]))

    def load_minute(self, freq: str, start: Day | None = None, end: Day | None = None,
                    symbols: list[str] | None = None) -> DataFrame:
        return as_double(self.scan("minute", start, end, freq=[freq], symbol=symbols))

    def query(self, sql: str) -> DataFrame:
        """Run SQL over the lake: every existing table is a view of its name."""
        for table in TABLES.values():
            self.scan(table.name).createOrReplaceTempView(table.name)
        return self.spark.sql(sql)

    # -- writes --------------------------------------------------------------------------

    def _clustered(self, table: Table, rows: DataFrame) -> DataFrame:
        """Rows of one partition close together, so that files are few; AQE cuts a partition
        that holds many rows into several tasks and merges small ones."""
        return rows.hint("rebalance", *table.partitions) if table.partitions else rows

    def _overwrite(self, table: Table, rows: DataFrame, path: str) -> None:
        if table.partitions:
            # The extra sort columns keep each file ordered for later range scans.
            lead = [c for c in ("symbol", "time") if c in table.columns]
            rows = rows.sortWithinPartitions(*table.partitions, *lead)
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if "symbol" in table.columns:
            # Files are sorted by symbol: a scan of one symbol reads the row groups and pages that may hold it.
            writer = writer.options(**{"parquet.bloom.filter.enabled#symbol": "true",
                                       "parquet.bloom.filter.expected.ndv#symbol": str(SYMBOLS),
                                       "parquet.page.row.count.limit": str(PAGE_ROWS)})
        (writer.partitionBy(*table.partitions) if table.partitions else writer).parquet(path)

    def _touched(self, table: Table, base: DataFrame, incoming: DataFrame, listed: list[Row]) -> DataFrame:
        """The part of ``base`` in the partitions of the batch, of which at most ``MAX_LISTED + 1`` are given.

        Up to ``MAX_LISTED`` partition values become a literal filter, so that only these
        directories are scanned; a batch that touches more joins on them instead. A null value
        is a partition like any other.
        """
        partitions = list(table.partitions)
        if len(listed) > MAX_LISTED:
            values = incoming.select(*partitions).distinct()
            wanted = values.select(*[F.col(c).alias(f"__{c}") for c in partitions])
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in partitions])
            return base.join(wanted, same, "left_semi")
        tail: dict[tuple, list[str]] = {}
        for row in listed:
            *head, last = (row[c] for c in partitions)
            tail.setdefault(tuple(head), []).append(last)

        def among(column: str, values: list) -> Column:
            inside = F.col(column).isin([v for v in values if v is not None])
            return inside | F.col(column).isNull() if None in values else inside

        conditions = [
            reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(partitions, head)],
                   among(partitions[-1], last))
            for head, last in tail.items()]
        return base.filter(reduce(lambda a, b: a | b, conditions))

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """The rows from files below the root, for as long as they are read again and again.

        Files take a fraction of the room of persisted rows, and the shuffles behind the rows are gone once they are written.
        """
        path = self.path(f"_batch/{uuid.uuid4().hex}")
        try:
            with tidy(rows.sparkSession):
                rows.write.parquet(path)
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            delete(self.spark, path)

    def upsert(self, name: str, incoming: DataFrame, order: str | list[str] | None = None,
               keep_states: bool = False, staged: bool = False) -> int:
        """Insert or update by key; returns the number of batch rows.

        New bars outdate the factor states of their months and all later ones, which are dropped, unless
        ``keep_states`` says that the caller sees to them. The batch is read more than once: it is ``staged``, unless
        the caller says that it is already.
        """
        table = TABLES[name]
        partitions = list(table.partitions)
        extra = [p for p in partitions if p not in table.columns]
        if "ym" in extra:
            incoming = incoming.withColumn("ym", month_of())
        for column, value in table.defaults:
            if column in partitions and column not in incoming.columns:
                incoming = incoming.withColumn(column, F.lit(value))
        if not partitions:
            return self._merge_whole(table, incoming, order)
        names = [order] if isinstance(order, str) else list(order or [])
        types = {f.name: f.dataType for f in table.schema}
        batch = incoming.select(*[F.col(c).cast(types[c]).alias(c) for c in table.columns if c in incoming.columns],
                                *extra, *[F.col(c).alias(f"{ORDER}_{k}") for k, c in enumerate(names)])
        ordered = [f"{ORDER}_{k}" for k in range(len(names))]
        with nullcontext(batch) if staged else self.staged(batch) as rows, tidy(self.spark):
            listed = rows.groupBy(*partitions).agg(F.count("*").alias("__n")).limit(MAX_LISTED + 1).collect()
            n = sum(r["__n"] for r in listed) if len(listed) <= MAX_LISTED else rows.count()
            if n and name == "daily" and not keep_states and self.months("factor_state"):
                self.drop_months("factor_state", rows.agg(F.min("ym").alias("ym")).first()["ym"])
            if n:
                self._merge_into(table, rows, extra, ordered, listed, n)
            return n

    def _merge_whole(self, table: Table, incoming: DataFrame, order: str | list[str] | None) -> int:
        """Tables without partitions are small."""
        base, incoming = self._read(table), incoming.persist()
        try:
            n = incoming.count()
            if not n:
                return 0
            merged = merge_table(table, base.select(*table.columns), incoming, order)
            staging = f"{self.root}/_staging/{table.name}"
            merged.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(staging)
            staged = self.spark.read.schema(merged.schema).parquet(staging)
            self._overwrite(table, staged, self.path(table.name))
            return n
        finally:
            incoming.unpersist()

    def _merge_into(self, table: Table, incoming: DataFrame, extra: list[str],
                    order: list[str], listed: list[Row], n: int) -> None:
        base = self._read(table)
        base = self._touched(table, base, incoming, listed)
        # The month follows from the key, so grouping by it keeps rows in their partition. One shuffle serves the merge
        # and the files: rows of a partition are dealt into as many slots as it has tasks' worth of rows, and are
        # sorted as the files are.
        slots = -(-(n + base.count()) // (SLOT_ROWS * len(listed)))
        slot = F.pmod(F.xxhash64(*table.key), F.lit(slots)).cast("int")
        lead = [c for c in ("symbol", "time") if c in table.columns]
        keys = dict.fromkeys([*table.partitions, *lead, *table.key, *extra, SLOT])
        keyed = replace(table, key=tuple(keys))
        merged = merge_table(keyed, base.select(*table.columns, *extra, slot.alias(SLOT)), incoming.withColumn(SLOT, slot),
                             order, [*table.partitions, SLOT])
        self._overwrite(table, merged.drop(SLOT), self.path(table.name))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Replace the partitions that ``rows`` falls into (the whole table if unpartitioned)."""
        table = TABLES[name]
        if "ym" in table.partitions:
            rows = rows.withColumn("ym", month_of())
        stored = self._stored(table)
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in stored])
        self._overwrite(table, self._clustered(table, rows), self.path(name))

    def _partitions(self, name: str) -> list[tuple[str, object]]:
        """(month, path) of every partition."""
        table = TABLES[name]
        if "ym" not in table.partitions or not self._exists(self.path(name)):
            return []
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.path(name)).getFileSystem(self.spark._jsc.hadoopConfiguration())
        levels = "/".join(f"{p}=*" for p in table.partitions)
        paths = [s.getPath() for s in fs.globStatus(fs_path(f"{self.path(name)}/{levels}")) or []]
        return [(next(part.split("=", 1)[1] for part in p.toString().split("/") if part.startswith("ym=")), p)
                for p in paths]

    def months(self, name: str) -> list[str]:
        """The months that have a partition, ascending."""
        return sorted({month for month, _ in self._partitions(name)})

    def drop_months(self, name: str, first: str | None = None, before: str | None = None) -> int:
        """Remove the partitions from month ``first`` on and before month ``before``; returns how many."""
        dropped = 0
        for month, path in self._partitions(name):
            if (first is None or month >= first) and (before is None or month < before):
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                dropped += 1
        return dropped

    def drop_partitions_before(self, name: str, day: Day) -> int:
        """Retention: remove whole months that end before ``day``; returns how many."""
        return self.drop_months(name, before=str(day)[:7])

    # -- catalog -------------------------------------------------------------------------

    def create_tables(self, database: str) -> list[str]:
        """Register every table as an external Parquet table of ``database``, whose own folder is
        below the root, not in the session's warehouse."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{self.path('_catalog')}'")
        for table in TABLES.values():
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._stored(table))
            by = f"PARTITIONED BY ({', '.join(table.partitions)})" if table.partitions else ""
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {database}.{table.name} ({columns}) USING parquet "
                f"{by} LOCATION '{self.path(table.name)}'")
        return list(TABLES)

    def publish_by_symbol(self, database: str, name: str, buckets: int = 64) -> DataFrame:
        """A copy of a panel table in the catalog, ``<name>_by_symbol``, bucketed and sorted by symbol.

        Panel joins and windows by symbol over such tables of equally many buckets need no shuffle: co-partitioning by
        a part of the join keys is allowed in this session from here on. A symbol is one bucket, so this is for
        panels whose symbols are of like size; runs over skewed ones read the tables by path.
        """
        self.spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        target = f"{database}.{name}_by_symbol"
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{self.path('_catalog')}'")
        rows = as_double(self.scan(name)).repartition(buckets, "symbol")
        rows.write.mode("overwrite").format("parquet").bucketBy(buckets, "symbol").sortBy("symbol", "time").option(
            "path", self.path(f"_by_symbol/{name}")).saveAsTable(target)
        return self.spark.table(target)

    def refresh_tables(self, database: str) -> None:
        """Make partitions written by path visible to the catalog tables."""
        written = [t for t in TABLES.values() if self._exists(self.path(t.name))]
        for table in written:
            if table.partitions:
                self.spark.sql(f"ALTER TABLE {database}.{table.name} RECOVER PARTITIONS")
            self.spark.sql(f"REFRESH TABLE {database}.{table.name}")


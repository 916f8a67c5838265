"""Session settings the library is written for."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "factorlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic, AQE and the RocksDB state store.

    ``shuffle.partitions`` is only a starting point: AQE coalesces small shuffle
    partitions and splits skewed join partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # Call sites are not recorded per column, which shortens the building of large plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Rows of a shuffle partition to start from, bytes that small ones are merged up to, and bytes of a scan task. Bars
# compress to some 25 bytes, so that 64 MB, Spark's own value, are millions of rows in the sorts of one task.
TASK_ROWS, TASK_BYTES, SCAN_BYTES = 50_000, "8m", "32m"


def bound_tasks(spark: SparkSession, rows: int) -> None:
    """From here on the session cuts shuffles of ``rows`` rows so fine that a task's share does not grow with them.

    More rows are more partitions, never larger ones; AQE merges small neighbours up to ``TASK_BYTES``.
    """
    number = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(number, str(max(least, -(-rows // TASK_ROWS))))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    spark.conf.set("spark.sql.files.maxPartitionBytes", SCAN_BYTES)


# Removes the shuffle files of an action when it ends; else they stay until the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(*sessions: SparkSession) -> Iterator[None]:
    """Actions inside leave no shuffle files behind. For results that are stored: none is read again from its shuffle."""
    before = [(s, s.conf.get(CLEAN_UP, None)) for s in sessions]
    try:
        for spark in sessions:
            spark.conf.set(CLEAN_UP, "true")
        yield
    finally:
        for spark, value in reversed(before):
            spark.conf.unset(CLEAN_UP) if value is None else spark.conf.set(CLEAN_UP, value)


STATE = "spark.sql.streaming.stateStore."
# MB that the state stores of one executor share for blocks and rows not written yet; all else of a state is on disk.
STATE_MB = 256


def state_on_disk(spark: SparkSession) -> None:
    """From here on streams of the session keep their state in RocksDB, in bounded memory.

    Spark's own store holds each row of a state on the heap, so that a state larger than the executors' memory fails. A
    stream that is started again stays with the store of its checkpoint.
    """
    spark.conf.set(f"{STATE}providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # Else each store of an executor has buffers and a cache of its own, and their number grows with the partitions.
    spark.conf.set(f"{STATE}rocksdb.boundedMemoryUsage", "true")
    spark.conf.set(f"{STATE}rocksdb.maxMemoryUsageMB", str(STATE_MB))
    # Counting rows reads every key before it is written.
    spark.conf.set(f"{STATE}rocksdb.trackTotalNumberOfRows", "false")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    On a cluster it is the one named in ``spark.checkpoint.dir``. Only a local
    session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(
        "factorlake.localShared", None
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("factorlake.localShared", own)
    return own


_written: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session is gone: the folder is left to the cluster's own clean-up
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def durable(df):
    """Reliable checkpoint: the rows are written to the shared folder and the lineage is cut."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()

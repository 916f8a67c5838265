"""What the operators share: input columns, written intermediates, the text of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.session import scratch

#: Fixed by the contracts: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, whatever executor is lost."""
    path = scratch(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch on its way to a Python task; rows may be as long as they like.
BATCH_BYTES = 4 * 2 ** 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from here on the session hands Python tasks batches bounded by bytes, not only by rows."""
    df.sparkSession.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df


def plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text, under fixed names, so that other columns cannot clash; for Python tasks
    in small batches."""
    return small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                     F.coalesce(F.col(text_col), F.lit("")).alias("text")))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else: the fast way for pure ASCII, else one by one."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


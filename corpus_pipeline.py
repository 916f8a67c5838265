"""A corpus pipeline: each stage works on all rows that the one before kept.

language_id -> exact_dedup -> near_dedup -> source_mix -> encode. All stages but the last return the
columns of the documents; ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.llm import bpe, exact_dedup, language_crf, mixing, setsketch
from factorlake.llm.common import stored, table

BYTE_RANKS = "byte_bpe_50k.tiktoken"
#: Below this mean probability a text is of no known language. Prose of any one learned language,
#: however short, is well above; ``und`` has 0.
LEAST_SCORE = 0.3
PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that fit no language that ``lang`` names.

    The model learns from the rows with a ``lang``; without any, nothing can be judged and every
    text with a letter stays.
    """
    model = language_crf.fit(docs)
    if model is None:
        return docs.where(F.rlike(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    return language_crf.keep_known(docs, model, LEAST_SCORE).where(F.rlike(F.col("text"), F.lit(r"\p{L}")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z: the least doc_id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return setsketch.drop_near_duplicates(docs, PERCENT)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; not taken at all, it goes.

    A document that the budget ends in is taken as a whole. Documents without words go.
    """
    mixed = mixing.mix(docs)
    # Rows of one text, identifier and source share their copies: which of them gets one more does not matter.
    times = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    times = mixed.groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                          F.col("mark").alias("__hash")).agg(
        F.sum(times).cast("int").alias("__times"), F.count("*").cast("int").alias("__rows")).where("__times > 0")
    same = (F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
            & (F.col("__mark") == F.col("__hash")))
    joined = docs.withColumn("__mark", mixing.text_mark(F.col("text"))).join(times, same)
    each, more = F.floor(F.col("__times") / F.col("__rows")).cast("int"), F.col("__times") % F.col("__rows")
    # At most one such group of a source, where its budget ends, does not divide evenly.
    even = joined.where(more == 0).withColumn("__each", each)
    place = F.row_number().over(Window.partitionBy("__id", "__source", "__hash").orderBy("__mark"))
    odd = joined.where(more > 0).withColumn("__each", each + F.when(place <= more, 1).otherwise(0)).where("__each > 0")
    return (even.unionByName(odd).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__each"))))
            .select(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded bytes of every row."""
    return bpe.encode(docs, public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("exact_dedup", exact_copies), ("near_dedup", near_copies),
    ("source_mix", source_mix), ("encode", encode)]

#: The first, third and last stage have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

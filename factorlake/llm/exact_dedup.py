"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition belongs to one run of ``RUNS``. Its rows are combined by digest before anything moves,
so a text that fills a third of the table is one row per run from then on. Then runs are merged in
binomial rounds: in round k, run r hands its entries to the run that has bit k of r cleared. The entries of both
runs are sorted by digest, so that equal digests are neighbours, and a window over neighbours keeps
one of them, with the best identifier and the number of rows of both. A digest is in a run once, so no window holds
more than two entries, however large a group is. After the last round one run is left: the table of groups.

A run is not one task: it is cut into slices by the first two bytes of the digest, and a slice of a pair of
runs is sorted and merged by itself, spilling where it has to.

An entry is verified at every level: neighbours are merged only if the SHA-256 digest, a second, unrelated
hash and the length in bytes agree, so that a collision of one digest would give two groups, not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.llm.common import ascii_lower, stored

#: A power of two: eight rounds.
RUNS = 256
KEY = ["sha", "hash", "size"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sha (binary), hash, size of the normalised text, and the run a row belongs to."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"),
                       F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"),
                       F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"))


def merge_pairs(runs: DataFrame, first: Column) -> DataFrame:
    """One binomial round: half as many runs, each the merged entries of two. ``first`` puts the better identifier first."""
    runs = runs.withColumn("run", F.shiftright("run", 1)).repartition("run", "slice")
    same = Window.partitionBy("run", "slice", *KEY).orderBy(first)
    both = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select("run", "slice", *KEY, "keep_id", F.sum("n").over(both).alias("n"),
                       F.row_number().over(same).alias("place"))
    return runs.where("place = 1").drop("place")


def tree_merge(rows: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per distinct text: its key, the identifier to keep and the number of rows."""
    best, first = {"smallest": (F.min, F.asc_nulls_last), "largest": (F.max, F.desc_nulls_last)}[keep]
    runs = rows.groupBy("run", F.substring("sha", 1, 2).alias("slice"), *KEY).agg(
        best("doc_id").alias("keep_id"), F.count("*").alias("n"))
    for _ in range(RUNS.bit_length() - 1):
        runs = merge_pairs(runs, first("keep_id"))
    return runs.drop("run", "slice")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Equal texts are equal after lower-casing A-Z; a null text counts as empty. A null
    identifier is below every other and is kept only where a group has no other. Rows that repeat
    the identifier that stays are all marked as kept. An empty table gives no row.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    groups = tree_merge(rows, keep)
    found = rows.join(groups, KEY)
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"),
                        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` without exact copies: one row of each group, all columns.

    Where the identifier that stays is listed on several equal rows, one of these stays.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    groups = tree_merge(rows, keep)
    winners = (rows.join(groups, KEY).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
               .groupBy("doc_id", *KEY).agg(F.count("*").alias("listed")))
    winners = winners.select(F.col("doc_id").alias("__id"), *[F.col(k).alias(f"__{k}") for k in KEY],
                             F.col("listed").alias("__listed"))

    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumns({"__h": F.xxhash64(text), "__s": F.octet_length(text)})
    joined = keyed.join(winners, F.col(id_col).eqNullSafe(F.col("__id"))
                        & (F.col("__h") == F.col("__hash")) & (F.col("__s") == F.col("__size")))
    once = joined.where("__listed = 1").select(docs.columns)
    again = joined.where("__listed > 1").dropDuplicates(["__id", "__sha"]).select(docs.columns)
    return once.unionByName(again)


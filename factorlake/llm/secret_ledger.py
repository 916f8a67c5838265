"""Secret scans over a ledger of blobs.

A text is a blob named by its digest; paths (documents, revisions of files) point to blobs.
A ledger holds what is known about (blob, rule version) pairs: the spans found, or none.
A scan looks up the blobs of its paths, searches only pairs that the ledger lacks, appends
them to the ledger and joins the spans back to all paths. A blob that a third of the paths
share is searched once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlake.llm.common import stored
from factorlake.session import scratch

#: Fixed values. (?i:) covers the letters of ``assign`` that stand for themselves.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ASSIGN_SIGN = r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]"""


class Rule(NamedTuple):
    """A kind of span. ``least`` is the length that the match, after ``head`` is cut off, needs;
    every text with a span passes the cheaper test ``sign``."""

    kind: str
    version: int
    pattern: str
    least: int
    sign: str
    head: str | None = None


#: In the order in which spans of one start are listed.
RULES = (
    Rule("assign", 1, ASSIGN, 6, ASSIGN_SIGN, ASSIGN_HEAD),
    # A run that is too short holds no match that starts later: counting in the pattern is the same.
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 24, "[0-9a-f]{24}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, "PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 40, "gh[pousr]_"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 28, "eyJ[A-Za-z0-9_-]{8}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, "xox[abprs]-"),
)
BASE = ("assign", "access", "hex")

SPAN = "struct<start:int,rank:int,kind:string,end:int>"
LEDGER = f"blob binary, kind string, version int, spans array<{SPAN}>"


PIECE = "struct<gap:int,size:int,long:boolean>"


def rule_pieces(text: Column, rule: Rule) -> Column:
    """All matches of a rule in order: the length of the text since the match before, that of the match, in code
    points, and whether the match is long enough. Those too short are no spans but hide what they cover."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)

    def piece(m: Column, g: Column) -> Column:
        body = F.regexp_replace(m, rule.head, "") if rule.head else m
        return F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), (F.length(body) >= rule.least).alias("long"))

    # One piece of text more than matches: the last has no match.
    pieces = F.filter(F.zip_with(found, gaps, piece), lambda p: p["size"].isNotNull())
    # Most texts have none of a kind: one test instead of the walk.
    return F.when(F.rlike(text, F.lit(rule.sign)), pieces).otherwise(F.array().cast(f"array<{PIECE}>"))


def spans_of_pieces(pieces: DataFrame) -> DataFrame:
    """(blob, kind, version, spans) from rows (blob, rank, kind, version, pieces): a match ends where all pieces
    up to it end, which is a running sum over the rows of one blob and rule."""
    key = ["blob", "rank", "kind", "version"]
    rows = pieces.where(F.size("pieces") > 0).select(*key, F.posexplode("pieces").alias("at", "p"))
    until = Window.partitionBy("blob", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.select(*key, "p.*", F.sum(F.col("p.gap") + F.col("p.size")).over(until).cast("int").alias("end"))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "kind", "end")
    listed = F.sort_array(F.collect_list(F.when(F.col("long"), span))).cast(f"array<{SPAN}>")
    return ends.groupBy(*key).agg(listed.alias("spans")).select("blob", "kind", "version", "spans")


def new_ledger(spark: SparkSession) -> str:
    """An empty ledger in the shared folder."""
    path = scratch(spark, "llm-ledger")
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, blob, spans (array of kind, start, end by start, then rule order) of every row.

    Appends what was searched to the ledger at path ``ledger``; the append is a set of whole
    files, and a pair that a broken run leaves twice reads as one. Null text counts as empty and
    has no spans; rows that repeat an identifier each get their spans.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    blob = F.unhex(F.sha2(text, 256))
    paths = docs.select(F.col(id_col).alias("doc_id"), blob.alias("blob"))
    # Blobs of which every rule version is known are left out by their digest alone.
    ruled = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]
    known = (spark.read.schema(LEDGER).parquet(ledger)
             .where(F.struct("kind", "version").isin(*ruled) if ruled else F.lit(False))
             .groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done")))
    # One row per blob: equal blobs are combined before and after the shuffle.
    blobs = (docs.select(blob.alias("blob"), text.alias("text")).where("text <> ''")
             .dropDuplicates(["blob"]))
    wanted = blobs.join(known.withColumnRenamed("blob", "seen"), F.col("blob") == F.col("seen"), "left")
    entries = []
    for rank, rule in enumerate(rules):
        done = F.array_contains(F.col("done"), ruled[rank])
        pieces = F.when(F.coalesce(done, F.lit(False)), F.lit(None)).otherwise(rule_pieces(F.col("text"), rule))
        entries.append(F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"),
                                F.lit(rank).alias("rank"), pieces.alias("pieces")))
    searched = stored(wanted.select("blob", F.explode(F.array(*entries)).alias("e"))
                      .select("blob", "e.*").where("pieces is not null"), "pieces")
    none = searched.where(F.size("pieces") == 0).select(
        "blob", "kind", "version", F.array().cast(f"array<{SPAN}>").alias("spans"))
    spans_of_pieces(searched).unionByName(none).write.mode("append").parquet(ledger)

    # A pair that a broken run left twice is one row.
    entries = (spark.read.schema(LEDGER).parquet(ledger)
               .where((F.struct("kind", "version").isin(*ruled)) & (F.size("spans") > 0))
               .groupBy("blob", "kind", "version").agg(F.first("spans").alias("spans")))
    found = (entries.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
             .withColumnRenamed("blob", "hit"))
    joined = paths.join(found, F.col("blob") == F.col("hit"), "left")
    return joined.select("doc_id", F.lower(F.hex("blob")).alias("blob"),
                         F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

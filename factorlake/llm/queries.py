"""Registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import (bpe, collocations, decision_list, exact_dedup, language_crf, license_scan, merkle, mixing,
                            secret_ledger, setsketch, substring_dedup, token_counts,
                            voronoi_join)
from factorlake.llm.common import stored, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BYTE_RANKS = "byte_bpe_50k.tiktoken"
WORD_TOKENS = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_crf.fit(docs.where(~held_out))
    found = language_crf.languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op2_bpe_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"),
                              public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"),
                                       public_tokenizers.path(WORD_TOKENS))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


@query
def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.scan(table(spark, sf_dir, "documents"), secret_ledger.new_ledger(spark))

    def spans_of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(spans_of(k)).cast("long").alias(f"n_{k}") for k in secret_ledger.BASE]
    base = spans_of(*secret_ledger.BASE)
    return found.select("doc_id", *counts, F.sha2(secret_ledger.listed(base), 256).alias("base_sha256"),
                        secret_ledger.listed(F.col("spans")).alias("spans"))


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query
def op8_substring_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=35, digest=True)


@query
def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query
def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(decision_list.statistics(table(spark, sf_dir, "documents")), "statistics")
    rules = decision_list.fit(stats, table(spark, sf_dir, "labels"))
    return decision_list.judge(stats, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "rule")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    changed = merkle.tampered_leaf(doc_id, n_chars, [source, lang], text)
    found = merkle.manifest(docs, [doc_id, source, lang, n_chars, text], lang, doc_id, changed)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, longest=4, top=2000, subsumed=80)


@query
def op13_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_join.jaccard_join(table(spark, sf_dir, "documents"), percent=80)

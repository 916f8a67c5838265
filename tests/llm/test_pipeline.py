"""The pipeline against its stages' brute-force versions."""

import sys
from collections import Counter
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[2])]

import corpus_pipeline  # noqa: E402
import numpy as np  # noqa: E402
import public_tokenizers as P  # noqa: E402
import tiktoken  # noqa: E402
from data import table_of  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_copies import brute_components, lower  # noqa: E402

from factorlake.llm import bpe, mixing  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    # Every document here is prose of a learned language: none is rejected.
    first = {}
    for i in sorted(rows):
        first.setdefault(lower(rows[i].text), i)
    left = [(i, rows[i].text) for i in first.values()]
    roots, _ = brute_components(left, corpus_pipeline.PERCENT)
    stay = sorted(i for i in roots if roots[i] == i)
    mixed = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(docs.where(docs.doc_id.isin(stay))).collect() if r.taken}

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = bpe.Ranks(file.read()).by_bytes
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i, library.encode_ordinary(rows[i].text)) for i, n in mixed.items() for _ in range(n))
    found = sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in corpus_pipeline.run(spark, SF).collect())
    assert found == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_mix_tells_rows_of_one_identifier_apart(spark):
    """Null identifiers of equal size: a row not taken does not come in with its twin, ties share theirs."""
    pairs = [(None, f"w{k} " * 10, "a") for k in range(20)] + [(7, "same text", "a")] * 3
    pairs += [(k, "other words here", "b") for k in range(60, 64)]
    docs = table_of(spark, [(i, t) for i, t, s in pairs if s == "a"], source="a").unionByName(
        table_of(spark, [(i, t) for i, t, s in pairs if s == "b"], source="b"))
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source, r.mark] += -(-r.taken // r.size)
    assert len({want[k] for k in want if k[0] is None}) > 1
    marked = corpus_pipeline.source_mix(spark, docs, SF).withColumn("mark", mixing.text_mark(F.col("text")))
    assert Counter((r.doc_id, r.source, r.mark) for r in marked.collect()) == +want


def test_language_is_judged_row_by_row(spark):
    """Rows of one identifier, or of none, do not speak for each other."""
    train = table_of(spark, [(k, f"the quick brown fox number {k} jumps over a lazy dog") for k in range(30)])
    odd = [(None, None), (None, "12345 67"), (None, "the lazy dog"), (3, "..."), (3, "the quick fox")]
    docs = train.unionByName(table_of(spark, odd))
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, docs, SF).collect())
    want = Counter((r.doc_id, r.text) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text))
    assert kept == want

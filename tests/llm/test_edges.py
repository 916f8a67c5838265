"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing names."""

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[2])]

import corpus_pipeline  # noqa: E402
import public_tokenizers as P  # noqa: E402
from data import EDGE, edge, empty  # noqa: E402

from factorlake.llm import (bpe, decision_list, exact_dedup, language_crf, license_scan,  # noqa: E402
                            mixing, secret_ledger, setsketch, substring_dedup, token_counts, voronoi_join)

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
PER_ROW = {
    "languages": lambda d: language_crf.languages(d, language_crf.fit(d, docs=5)),
    "encode": lambda d: bpe.encode(d, RANKS, P.PATTERN),
    "token_counts": lambda d: token_counts.token_counts(d, WORDS),
    "secrets": lambda d: secret_ledger.scan(d, secret_ledger.new_ledger(d.sparkSession)),
    "exact_groups": exact_dedup.exact_groups,
    "mix": mixing.mix,
    "remove_repeats": lambda d: substring_dedup.remove_repeats(d, width=20, gram=5),
    "near_duplicates": setsketch.near_duplicates,
    "jaccard_join": voronoi_join.jaccard_join,
    "statistics": lambda d: decision_list.judge(decision_list.statistics(d), []),
}
#: Rows that stay of the edge table: by stage, on the table itself.
STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_every_row(spark, name):
    found = PER_ROW[name](edge(spark)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r[0]) for r in EDGE)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, name):
    assert PER_ROW[name](empty(spark)).collect() == []


def test_licenses_on_edges(spark):
    assert license_scan.licenses(edge(spark)).collect() == []
    assert license_scan.licenses(empty(spark)).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, name):
    found = STAGES[name](spark, empty(spark), "")
    assert found.collect() == []
    if name != "encode":
        assert found.columns == empty(spark).columns


def kept(df):
    return sorted(str(r.doc_id) for r in df.collect())


def test_stages_on_edges(spark):
    docs = edge(spark)
    assert kept(STAGES["language_id"](spark, docs, "")) == sorted(
        ["1", "11", "4", "4", "6", "7", "8", "9", "None"])
    # Equal: 1, null and 6; 2, 3 and a null one; 4 twice, of which one row stays.
    assert kept(STAGES["exact_dedup"](spark, docs, "")) == sorted(
        ["1", "10", "11", "2", "4", "5", "7", "8", "9"])
    # Texts without words stay here, each on its own.
    assert kept(STAGES["near_dedup"](spark, docs, "")) == sorted(
        ["1", "10", "11", "2", "3", "4", "4", "5", "7", "8", "9", "None"])
    mixed = STAGES["source_mix"](spark, docs, "").collect()
    assert {r.doc_id for r in mixed} <= {1, 4, 6, 7, 8, 9, 10, 11, None}
    assert all(r.text.strip() for r in mixed)
    assert STAGES["encode"](spark, docs, "").count() == len(EDGE)

"""Language, quality rules and licences: held-out accuracy, brute force and planted cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from data import SCHEMA, table_of
from factorlake.llm import decision_list, language_crf, license_scan

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return language_crf.fit(documents.where(~held), docs=80)


def test_held_out_accuracy(documents, model):
    found = language_crf.languages(documents, model).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_the_fit_is_the_same_in_any_layout(documents, model):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = language_crf.fit(documents.where(~held).repartition(7), docs=80)
    assert np.array_equal(model.weights, other.weights) and model.labels == other.labels


def test_mixed_text_is_cut_where_the_language_changes(spark, documents, model):
    one = documents.where("lang = 'de' and n_chars > 500").orderBy("doc_id").first().text[:300]
    two = documents.where("lang = 'es' and n_chars > 500").orderBy("doc_id").first().text[:300]
    spans = language_crf.language_spans(table_of(spark, [(1, one + " " + two)]), model).collect()
    long = [s.lang for s in sorted(spans, key=lambda s: s.start) if s.n_words >= 10]
    assert long[0] == "de" and long[-1] == "es"


def test_no_letter_and_no_model(spark, model):
    docs = table_of(spark, [(1, None), (2, "12 ½ ..."), (3, "the")])
    by = {r.doc_id: (r.lang_pred, r.score) for r in language_crf.languages(docs, model).collect()}
    assert by[1] == by[2] == ("und", 0.0) and by[3][0] in model.labels
    assert {r.lang_pred for r in language_crf.languages(docs, None).collect()} == {"und"}
    assert language_crf.fit(spark.createDataFrame([], SCHEMA)) is None


def test_forward_backward_equals_enumeration():
    draw = np.random.default_rng(1)
    size, lengths = 3, np.array([1, 4, 2])
    scores, start, moves = draw.normal(size=(7, size)), draw.normal(size=size), draw.normal(size=(size, size))
    found = language_crf.forward_backward(scores, lengths, start, moves)
    at = 0
    for n in lengths:
        want = np.zeros((n, size))
        for path in np.ndindex(*[size] * n):
            w = start[path[0]] + sum(scores[at + k, y] for k, y in enumerate(path)) + sum(
                moves[a, b] for a, b in zip(path, path[1:]))
            for k, y in enumerate(path):
                want[k, y] += np.exp(w)
        assert np.allclose(found[at:at + n], want / want.sum(1, keepdims=True))
        at += n


def brute_stats(text):
    text = text or ""
    space = " \t\n\r\x0b\x0c"
    words, now = [], ""
    for c in text + " ":
        if c in space:
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    again = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if x.strip(space)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:k] for k, x in enumerate(lines)), len(again))


def test_statistics_against_brute_force(spark):
    pick = random.Random(3)
    texts = [None, "", " \n ", "a\nb\na\n a\n\n", "é½ 🙂#<| x"] + [
        "".join(pick.choice(["ab ", "c ", "\n", "d\t", "# "]) for _ in range(pick.randint(1, 80))) for _ in range(40)]
    found = decision_list.statistics(table_of(spark, list(enumerate(texts)))).collect()
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(
            texts[r.doc_id])


def test_rules_find_planted_thresholds_and_spare_good_rows():
    draw = np.random.default_rng(2)
    x = draw.random((4000, 3))
    bad = ((x[:, 0] > 0.8) & (x[:, 1] <= 0.5)) | (x[:, 2] > 0.95)
    rules = decision_list.learn(x, bad, ["words", "symbols_per_word", "repeat_share"])
    covered = np.zeros(len(x), bool)
    for rule in rules:
        covered |= decision_list._holds(x, ["words", "symbols_per_word", "repeat_share"], rule.conditions)
    assert 2 <= len(rules) <= 6
    assert bad[covered].mean() > 0.97 and covered[bad].mean() > 0.9


def test_rules_from_labels(spark, documents):
    stats = decision_list.statistics(documents)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    judged = decision_list.judge(stats, decision_list.fit(stats, labels)).join(labels, "doc_id").collect()
    good = [r for r in judged if r.quality == 1 and not r.base_failed]
    bad = [r for r in judged if r.quality == 0]
    assert np.mean([r.kept for r in good]) > 0.99 and np.mean([r.kept for r in bad]) < 0.4
    assert all((r.rule > 0) == (not r.kept) for r in judged if not r.base_failed)


def test_no_labels_no_rules(spark, documents):
    stats = decision_list.statistics(documents)
    none = spark.createDataFrame([(None, 0), (1, None), (2, 5)], "doc_id long, quality int")
    assert decision_list.fit(stats, none) == []


def test_licenses_against_wording(spark):
    texts = {
        1: "some prose here.\n" + license_scan.TEMPLATES["GPL-3.0"],
        2: license_scan.TEMPLATES["MIT"].upper() + " more words " * 40 + license_scan.TEMPLATES["CC-BY-NC-4.0"],
        3: "the license of a driver is needed to drive",
        4: license_scan.TEMPLATES["MIT-text"].replace("modify, merge", "change, merge").replace(" ", "\n"),
        5: "licensed under CC BY 4.0. and then Licensed under CC BY-SA 4.0.",
        6: license_scan.TEMPLATES["Apache-2.0-header"],
    }
    found = sorted((r.doc_id, r.start, r.license, r.missing, r.added)
                   for r in license_scan.licenses(table_of(spark, list(texts.items()))).collect())
    assert [(d, name) for d, _, name, _, _ in found] == [
        (1, "GPL-3.0"), (2, "MIT"), (2, "CC-BY-NC-4.0"), (4, "MIT-text"), (5, "CC-BY-4.0"),
        (5, "CC-BY-SA-4.0"), (6, "Apache-2.0-header")]
    assert found[3][3:] == ("modify", "change")
    assert found[0][1] == len("some prose here.\n")


def test_whole_licenses_are_told_apart(spark):
    """Each whole text, wrapped anew as a comment, after a title and before prose, is found from end to end."""
    texts = {}
    for k, name in enumerate(license_scan.WHOLE):
        words = license_scan.TEMPLATES[name].split()
        lines = [" # " + " ".join(words[i:i + 7]) for i in range(0, len(words), 7)]
        texts[k] = "Copyright 2020 A. Writer. This is the License.\n" + "\n".join(lines) + "\n" + "more prose " * 100
    found = license_scan.licenses(table_of(spark, list(texts.items()))).collect()
    assert [(r.doc_id, r.license, r.missing) for r in sorted(found, key=lambda r: r.doc_id)] == [
        (k, name, "") for k, name in enumerate(license_scan.WHOLE)]
    # The opening that BSD licences share names none of them.
    opening = table_of(spark, [(1, license_scan.TEMPLATES["BSD"].replace(" ", "\n"))])
    assert [r.license for r in license_scan.licenses(opening).collect()] == ["BSD"]


def test_names_and_versions_are_not_forgiven(spark):
    work = "This work is licensed under the GNU {}."
    bsd = license_scan.TEMPLATES["BSD-3-Clause-text"]
    cases = [
        (work.format("General Public License, version 2"), ["GPL-2.0"]),
        (work.format("General Public License, version 3.0"), ["GPL-3.0"]),
        (work.format("General Public License, version 4"), []),
        (work.format("Lesser General Public License, version 3"), ["LGPL-3.0"]),
        (work.format("Library General Public License, version 3"), []),
        ("Licensed under the Apache License, Version 2", ["Apache-2.0"]),
        ("Licensed under the Apache License, Version 1.1.", []),
        (license_scan.TEMPLATES["MPL-2.0"].replace("2.0", "1.1"), []),
        (license_scan.TEMPLATES["GPL-3.0-header"].replace("version 3", "version 1"), []),
        (license_scan.TEMPLATES["BSD-2-Clause-text"], ["BSD-2-Clause-text"]),
        (bsd, ["BSD-3-Clause-text"]),
        (bsd.replace("the copyright holder nor", "A. Writer nor"), ["BSD-3-Clause-text"]),
        (license_scan.TEMPLATES["BSD-4-Clause-text"].replace("by the organization", "by A. Writer"), ["BSD-4-Clause-text"]),
    ]
    found = license_scan.licenses(table_of(spark, [(k, text) for k, (text, _) in enumerate(cases)])).collect()
    assert [[r.license for r in found if r.doc_id == k] for k in range(len(cases))] == [names for _, names in cases]
    # What stands in the place of a missing last word is listed.
    edge = license_scan.TEMPLATES["Apache-2.0-header"].removesuffix("at") + "from the author"
    row, = license_scan.licenses(table_of(spark, [(1, edge)])).collect()
    assert (row.license, row.missing, row.added) == ("Apache-2.0-header", "at", "from")


def test_planted_licenses_are_all_found(documents):
    lines = documents.where(F.rlike("text", F.lit("(?i)licen[cs]ed? under|MIT License"))).select("doc_id").distinct()
    found = license_scan.licenses(documents).select("doc_id").distinct()
    assert {r.doc_id for r in lines.collect()} == {r.doc_id for r in found.collect()}


def test_short_wordings(spark):
    cases = {
        "Licensed under the MIT License.": "MIT",
        "This project is licensed under the MIT License": "MIT",
        "SPDX-License-Identifier: MIT": "MIT",
        "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
        "released under the Apache 2.0 license": "Apache-2.0",
        "Licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "under the terms of the GNU LGPL v2.1": "LGPL-2.1",
        "distributed under MPL 2.0": "MPL-2.0",
        "released under\n * GPLv3.0": "GPL-3.0",
        "available under MIT": "MIT",
        "CC BY-SA 4.0": "CC-BY-SA-4.0",
        "CC BY 3.0": "CC-BY-3.0",
        "CC-BY-4.0": "CC-BY-4.0",
        "CC0 1.0 Universal": "CC0-1.0",
        "Creative Commons Attribution-ShareAlike 4.0 International": "CC-BY-SA-4.0",
        license_scan.TEMPLATES["ISC-text"].replace("THE AUTHOR", "ISC"): "ISC-text",
        # No notices.
        "I went to MIT for a license": None,
        "licensed under the license of mit": None,
        "a license under the GNU General Public License version 7": None,
        "CC BY 9.0": None,
    }
    around = [("", ""), ("some more prose here. " * 9, " And again more prose." * 9)]
    texts = [before + text + after for text in cases for before, after in around]
    found = license_scan.licenses(table_of(spark, list(enumerate(texts)))).collect()
    got = [[r.license for r in found if r.doc_id == k] for k in range(len(texts))]
    assert got == [[name] if name else [] for name in cases.values() for _ in around]


def test_every_template_at_every_cue():
    """Without the filter by words, every template compared at every cue gives the same notices."""
    names = ["MIT", "MIT-opening", "Apache-2.0", "Apache-2.0-header", "BSD", "MPL-2.0", "GPL-2.0", "GPL-3.0-header", "LGPL-3.0",
             "CC-BY-4.0", "CC-BY-SA-4.0", "MIT-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "ISC-text",
             *[name for name in license_scan.SHORT if name.startswith(("MIT", "GPL-3.0", "CC-BY", "Apache"))][::7]]
    templates = {name: license_scan.TEMPLATES[name] for name in names}

    class Every(license_scan.Scanner):
        def possible(self, bag, name):
            return True

    every = Every(dict(reversed(templates.items())))
    scanner = license_scan.Scanner(templates)
    pick = random.Random(4)
    n = 0
    for _ in range(60):
        parts = []
        for _ in range(pick.randint(1, 4)):
            words = templates[pick.choice(names)].split()
            for _ in range(pick.choice([0, 0, 1, 2, len(words) // 8])):
                k = pick.randrange(len(words))
                words[k:k + 1] = pick.choice([[], ["license"], ["other"], [words[k], "the"]])
            parts += [" ".join(words), "prose of a license " * pick.randint(0, 3)]
        text = " ".join(parts)
        assert scanner.find(text) == every.find(text)
        n += len(scanner.find(text))
    assert n > 60


def test_alignment_is_one_rule():
    """With the rarer words as anchors nothing is lost on texts that hold the whole template, whatever its length."""
    for name in ["MIT", "GPL-2.0-header", "ISC-text", "BSD-2-Clause-text", "Apache-2.0-text"]:
        words = license_scan.normal(license_scan.TEMPLATES[name])
        for text in (words, ["the"] * 5 + words + ["of"] * 5, words[:len(words) // 2] + ["new"] + words[len(words) // 2:]):
            runs = license_scan.aligned(text, words)
            assert sum(n for _, _, n in runs) == len(words)
            assert all(text[a:a + n] == words[b:b + n] for a, b, n in runs)
            assert all(a + n <= c and b + n <= d for (a, b, n), (c, d, _) in zip(runs, runs[1:]))

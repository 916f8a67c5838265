"""Collocations against counting by hand."""

import random
import re
from collections import Counter, defaultdict

import pytest
from data import edge, empty, table_of

from factorlake.llm import collocations


def brute(pairs, least, longest, top, subsumed):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in pairs:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                for k in range(len(words) - m + 1):
                    counts[lang or "und"][tuple(words[k:k + m])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}

        def holds(longer, p):
            return any(longer[k:k + len(p)] == p for k in range(len(longer) - len(p) + 1))

        scored = []
        for p, a in candidates.items():
            if any(len(x) > len(p) and 100 * b >= subsumed * a and holds(x, p) for x, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed):
    pick = random.Random(seed)
    words = ["a", "b", "c", "dd", "Ee", "é", "É", "x1"]
    out = []
    for _ in range(300):
        parts = [pick.choice(words) for _ in range(pick.randrange(12))]
        if pick.random() < 0.5:
            parts[pick.randrange(len(parts) + 1):0] = ["new", "York", "city", pick.choice(["hall", "park"])]
        text = "".join(w + pick.choice([" ", " ", " ", " \t", ", ", ".", "\n", "\r\n", " ; "]) for w in parts)
        out.append((pick.choice(["en", "en", "fr", None, "und"]), text))
    return out + [(None, None), ("en", ""), ("fr", "..., !")]


def docs_of(spark, pairs):
    schema = table_of(spark, []).schema
    return spark.createDataFrame([(k, t, lang, "s", None, *["x"] * 7) for k, (lang, t) in enumerate(pairs)], schema)


@pytest.mark.parametrize("least,top", [(2, 2000), (5, 7)])
def test_equals_brute_force(spark, monkeypatch, least, top):
    monkeypatch.setattr(collocations, "CHUNK", 500)
    pairs = texts(least)
    found = collocations.collocations(docs_of(spark, pairs).repartition(5), least, 4, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(pairs, least, 4, top, 80)


def test_two_words_at_most(spark):
    pairs = texts(9)
    found = collocations.collocations(docs_of(spark, pairs), 3, 2)
    assert sorted(tuple(r) for r in found.collect()) == brute(pairs, 3, 2, 2000, 80)


def test_edges(spark):
    assert collocations.collocations(empty(spark)).collect() == []
    found = collocations.collocations(edge(spark), least=2, longest=3, top=3).collect()
    assert {r.lang for r in found} == {"en"}
    assert max(r.rank for r in found) == 3

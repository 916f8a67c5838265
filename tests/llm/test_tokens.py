"""BPE and token counts against the libraries, and the parts they are made of."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from data import table_of  # noqa: E402
from factorlake.llm import bpe, token_counts

ODD = ["", " ", "  ", "a", "a" * 700, "ab" * 400, "the" * 300, "  \n\n x\t\ty  ", "it's WE'LL I'D 'S",
       "naïve 北京 ½²³ x y z \x1c\x1f \x85 end", "<|endoftext|>", "a<|startoftext|>b<|endoftext|", "é" * 300,
       "é İıΣς ΑΣ", "0123456789abcdef" * 40, "🙂🙃" * 50, "ǅ ʰ ߀ ١٢ Ⅷ", "Ÿ ſ Ñ ×÷ ª º µ ß ĲŉĿ ȺɁ",
       "###$$$ %%% &&&", "x \n y", "c  d", "p\n\n q", "don't 's ' t"]


def noise(n, letters, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(letters) for _ in range(pick.randint(1, 600))) for _ in range(n)]


TEXTS = ODD + noise(30, "etaoin ", 1) + noise(30, "aab", 2) + noise(30, "abcdefgh é\n0.'", 3)


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def encoder(request):
    with open(P.path(request.param), "rb") as file:
        return bpe.Encoder(file.read(), P.PATTERN)


def test_ids_equal_the_library(encoder):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks.by_bytes,
                                special_tokens={})
    for text, ids in zip(TEXTS, encoder.encode(TEXTS)):
        assert ids.tolist() == library.encode_ordinary(text), text[:40]
        assert encoder.decode(ids) == text.encode()


def test_both_queues_agree(encoder):
    words = [w.encode() for t in TEXTS for w in encoder.pattern.findall(t)]
    ids, counts = bpe.merge_many(words, encoder.ranks)
    for word, piece in zip(words, np.split(ids, np.cumsum(counts)[:-1])):
        assert piece.tolist() == bpe.merge_one(word, encoder.ranks).tolist()


def test_very_long_pretoken(encoder):
    word = ("".join(noise(60, "etaoinshr", 4))).encode()
    assert len(word) > 10_000
    text = word.decode()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks.by_bytes,
                                special_tokens={})
    assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_queue_gives_ranks_in_order():
    queue, pick = bpe.Queue(50_000), random.Random(5)
    ranks = [pick.randrange(50_000) for _ in range(500)]
    for k, r in enumerate(ranks):
        queue.push(r, k)
    out = []
    while (r := queue.least()) >= 0:
        out += [r] * len(queue.take(r))
    assert out == sorted(ranks)


def test_encoder_forgets_and_stays_right(encoder, monkeypatch):
    want = [x.tolist() for x in encoder.encode(TEXTS)]
    monkeypatch.setattr(bpe, "KNOWN", 10)
    assert [encoder.encode([t])[0].tolist() for t in TEXTS] == want


def test_encode_and_digests_agree(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(None, None)],
                                 "doc_id long, text string")
    full = {r.doc_id: r for r in bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for r in bpe.encode_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        row = full[r.doc_id]
        assert bytes(row.decoded) == (TEXTS[r.doc_id] if r.doc_id is not None else "").encode()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(row.ids) // 4, hashlib.sha256(row.ids).hexdigest(), hashlib.sha256(row.decoded).hexdigest())


@pytest.fixture(scope="module")
def counter():
    with open(P.path("word_bpe_49k.json")) as file:
        return token_counts.TokenCounter(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def counts_of(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_totals_equal_the_library(counter, library):
    assert counter.totals(TEXTS) == counts_of(library, TEXTS)


@pytest.mark.parametrize("word", ["tokenization", "internationalisation", "aaaaaaaaab", "thththwhere"])
def test_every_prefix_of_a_word(counter, library, word):
    prefixes = [word[:k] for k in range(1, len(word) + 1)]
    assert counter.table.at_every_prefix(word) == counts_of(library, prefixes)


@pytest.mark.parametrize("limit", [0, 1, 7, 50, 10 ** 6])
def test_budgets_equal_the_library(spark, library, limit):
    """Whole texts, special strings included: the longest part that fits, against encoding every prefix."""
    words = noise(40, "etaoin", 6) + ["internationalisation", "tokenization"]
    texts = [" ".join(words), "", None, "<|endoftext|>", "one <|endoftext|> two <|endoftext|><|endoftext|> " + " ".join(words[:9])]
    docs = table_of(spark, list(enumerate(texts)))
    found = {r.doc_id: r for r in token_counts.within_budget(docs, P.path("word_bpe_49k.json"), limit).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        units = (text or "").replace("<|endoftext|>", " <|endoftext|> ").split()
        upto = counts_of(library, [" ".join(units[:n]) for n in range(len(units) + 1)])
        kept = max(n for n, tokens in enumerate(upto) if tokens <= limit)
        more, cut = 0, upto[kept]
        if kept < len(units) and not units[kept].startswith("<"):
            heads = [units[kept][:n] for n in range(1, len(units[kept]) + 1)]
            tokens = counts_of(library, [" ".join([*units[:kept], head]) for head in heads])
            fits = [n for n, t in enumerate(tokens, 1) if t <= limit and upto[kept] < limit]
            if fits:
                more, cut = fits[-1], tokens[fits[-1] - 1]
        assert tuple(found[k])[1:] == (len(units), kept, upto[kept], more, cut), (k, limit)


def test_a_second_merge_of_a_token_is_refused():
    with pytest.raises(ValueError):
        token_counts.Merges([["a", "b"], ["ab", "c"], ["b", "c"], ["a", "bc"]], ["a", "b", "c"])

"""Token counts of a word-end BPE vocabulary by dynamic programming over prefixes.

For each prefix of a word the table holds the last token of its encoding and the number of
tokens. A token that ends at ``i`` is that last token exactly if the encoding of what is before it
ends with a token that may stand in front of it, that is, if no merge across the border would
come before the merges that made both. So one pass gives the exact count at every prefix, and
questions about budgets and truncation need no second encoding.

Inside a word no merge has seen the end of the word, so the table over plain symbols serves every
prefix; one more step with a token that carries the word-end mark gives the count of a text
that stops there.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from factorlake.llm.common import plain

NEVER = 1 << 40
#: Distinct words remembered by a task before it starts anew.
KNOWN = 300_000

#: The vocabulary's own pattern for texts made of ASCII and precomposed Latin letters, which its
#: normaliser only lower-cases; other texts pass through the library's normaliser and pattern.
LATIN = "A-Za-zÀ-ÖØ-öø-ſ"
SPACE = "\\t-\\r "
PLAIN = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ſ]")
WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{LATIN}]+|[0-9]|[^{SPACE}{LATIN}0-9]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = sorted(set(range(256)) - set(kept))
    names = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}
    return [names[b] for b in range(256)]


class Merges:
    """Tokens by the merge that makes each, and which of them may stand side by side."""

    def __init__(self, merges: list[list[str]], symbols: list[str]):
        self.rank = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.born = dict.fromkeys(symbols, -1)
        self.halves: dict[str, tuple[str, str]] = {}
        self.beside: dict[tuple[str, str], bool] = {}
        for (a, b), k in self.rank.items():
            if a + b in self.born or a not in self.born or b not in self.born:
                raise ValueError(f"merge {k}: each token needs one merge, after those of its halves")
            self.born[a + b], self.halves[a + b] = k, (a, b)
        # Tokens that their own text leads to; the others never come out.
        self.reached = set(symbols)
        for (a, b), k in self.rank.items():
            if a in self.reached and b in self.reached and self._stay(a, b, k):
                self.reached.add(a + b)
        self.longest = max(map(len, self.reached))

    def _stay(self, left: str, right: str, until: int) -> bool:
        """Do both last side by side until merge ``until``?

        Goes back in time along the border: the half that was made later is undone, until both
        are symbols. ``left_end`` and ``right_end`` are the merges that take up the present
        halves. A merge across the border that comes before them breaks the pair. Equal ranks
        go from left to right: the left half's own merge is before, the right half's is after.
        """
        left_end = right_end = until
        born, halves = self.born, self.halves
        while True:
            across = self.rank.get((left, right), NEVER)
            if across < left_end and across <= right_end:
                return False
            if born[left] > born[right]:
                left_end, left = born[left], halves[left][1]
            elif born[right] >= 0:
                right_end, right = born[right], halves[right][0]
            else:
                return True

    def may_follow(self, left: str, right: str) -> bool:
        known = self.beside.get((left, right))
        if known is None:
            known = self.beside[left, right] = self._stay(left, right, NEVER - 1)
        return known


class PrefixTable:
    """The encoding of every prefix of a word: last tokens and counts."""

    def __init__(self, merges: Merges, end: str):
        self.merges, self.end = merges, end

    def _last(self, word: str, i: int, lasts: list[str], mark: str) -> tuple[str, int]:
        reached, follow = self.merges.reached, self.merges.may_follow
        for j in range(max(0, i - self.merges.longest), i):
            token = word[j:i] + mark
            if token in reached and (j == 0 or follow(lasts[j], token)):
                return token, j
        raise ValueError(f"no encoding for {word[:i]!r}")

    def rows(self, word: str) -> tuple[list[str], list[int]]:
        """Last tokens and counts of the prefixes inside the word, the empty one first."""
        lasts, counts = [""], [0]
        for i in range(1, len(word)):
            token, j = self._last(word, i, lasts, "")
            lasts.append(token)
            counts.append(counts[j] + 1)
        return lasts, counts

    def total(self, word: str) -> int:
        """Tokens of the whole word."""
        lasts, counts = self.rows(word)
        return counts[self._last(word, len(word), lasts, self.end)[1]] + 1

    def at_every_prefix(self, word: str) -> list[int]:
        """Tokens of a text that stops after 1, 2, ... symbols of the word."""
        lasts, counts = self.rows(word)
        return [counts[self._last(word, i, lasts, self.end)[1]] + 1 for i in range(1, len(word) + 1)]


class TokenCounter:
    """Counts for texts under the settings of a tokenizer file."""

    def __init__(self, settings: str):
        self.settings = settings
        read = json.loads(settings)
        model = read["model"]
        self.symbol = byte_symbols()
        end = model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.table = PrefixTable(
            Merges(merges, [s + mark for s in self.symbol for mark in ("", end)]), end)
        special = [re.escape(t["content"]) for t in read["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.library: Tokenizer | None = None
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = defaultdict(count().__next__)
        self.counts = np.zeros(0, np.int64)
        self.table.merges.beside.clear()

    def learn(self) -> None:
        fresh = list(islice(self.words, len(self.counts), None))
        if fresh:
            total = self.table.total
            self.counts = np.append(self.counts, [total(w) for w in fresh])

    def symbols(self, word: str) -> str:
        return "".join([self.symbol[b] for b in word.encode()])

    def split(self, text: str) -> list[str]:
        """The words of a text in the vocabulary's symbols; ASCII letters stand for themselves."""
        if not PLAIN.search(text):
            return [w if w.isascii() else self.symbols(w) for w in WORDS.findall(text.lower())]
        if self.library is None:
            self.library = Tokenizer.from_str(self.settings)
        normal = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def parts(self, text: str) -> tuple[list[str], int]:
        """The words, and the number of special strings, each a token of its own."""
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        parts = self.special.split(text)
        return [w for part in parts for w in self.split(part)], len(parts) - 1

    def units(self, text: str) -> list[str | None]:
        """Words and special strings (None) in the order of the text."""
        if self.special is None or not self.special.search(text):
            return self.split(text)
        found: list[str | None] = []
        for k, part in enumerate(self.special.split(text)):
            if k:
                found.append(None)
            found += self.split(part)
        return found

    def totals(self, texts: list[str]) -> list[int]:
        if len(self.words) > KNOWN:
            self.forget()
        numbers, extra = [], []
        for text in texts:
            words, special = self.parts(text)
            numbers.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
            extra.append(special)
        self.learn()
        return [int(self.counts[n].sum()) + e for n, e in zip(numbers, extra)]

    def running(self, text: str) -> tuple[list[str | None], np.ndarray]:
        """The units of a text and the tokens at the end of each."""
        if len(self.words) > KNOWN:
            self.forget()
        units = self.units(text)
        numbers = np.fromiter((-1 if u is None else self.words[u] for u in units), np.int64, len(units))
        self.learn()
        return units, np.cumsum(np.where(numbers < 0, 1, np.append(self.counts, 1)[numbers]))

    def within(self, text: str, limit: int) -> tuple[int, int, int, int]:
        """What of a text fits into ``limit`` tokens: whole units and their tokens; then of the word in which
        the budget ends the most bytes that still fit, and the tokens with these."""
        units, running = self.running(text)
        whole = int(np.searchsorted(running, limit, side="right"))
        used = int(running[whole - 1]) if whole else 0
        if whole == len(units) or units[whole] is None or used >= limit:
            return whole, used, 0, used
        # The counts of a word's prefixes are in its table: no second encoding.
        fits = [i for i, n in enumerate(self.table.at_every_prefix(units[whole]), 1) if used + n <= limit]
        if not fits:
            return whole, used, 0, used
        return whole, used, fits[-1], used + self.table.at_every_prefix(units[whole])[fits[-1] - 1]


SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every row.

    ``vocabulary`` is a tokenizer file that the driver can read: byte-level BPE with a word-end
    mark. No special tokens are added; special strings in a text count as one token. Null or
    empty text has 0 bytes and 0 tokens; rows that repeat an identifier are counted one by one.
    """
    with open(vocabulary, encoding="utf-8") as file:
        settings = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(settings.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            step = max(1, len(texts) * 2_000_000 // max(1, batch.column(1).nbytes))
            n = [t for k in range(0, len(texts), step) for t in counter.totals(texts[k:k + step])]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    return plain(docs, id_col, text_col).mapInArrow(run, SCHEMA)


BUDGET = "doc_id long, n_units long, n_units_kept long, n_tokens_kept long, n_bytes_more long, n_tokens_cut long"


def within_budget(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """What of every whole text fits into ``limit`` tokens, from the counts of its prefixes.

    doc_id; n_units: its words and special strings; n_units_kept: as many of these from the start as fit, with
    n_tokens_kept tokens; n_bytes_more: bytes of the next word, normalised, that fit as well if it is cut there, and
    n_tokens_cut, the tokens of the text so cut. Special strings are never cut. Null or empty text: zeros; rows
    that repeat an identifier are answered one by one.
    """
    with open(vocabulary, encoding="utf-8") as file:
        settings = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(settings.value)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                whole, used, more, cut = counter.within(text.as_py(), limit)
                rows.append((len(counter.units(text.as_py())), whole, used, more, cut))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]],
                                             names=[f.split()[0] for f in BUDGET.split(", ")])

    return plain(docs, id_col, text_col).mapInArrow(run, BUDGET)

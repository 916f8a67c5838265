"""Phrase collocations by stripes.

A stripe is an associative array: for a language and a prefix of words, how often each next word follows it,
and how often a piece of text ends after it. Tasks fill stripes from whole texts and send each as
one row; stripes of one prefix are merged elementwise. One structure then answers everything:

* the entry of a next word is the number of occurrences of the prefix with that word;
* the sum of a word's stripe, ends included, is the number of occurrences of the word;
* the largest entry of a stripe is what the prefix's extensions to the right can subsume, and entries
  regrouped by their phrase without its first word give the same for extensions to the left.

Long prefixes are only followed where every pair of neighbours within the phrase is frequent enough. Tasks know
that from a bitmap of fixed size that holds all such pairs and a few others, so it only ever leaves out
phrases that are too rare.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.llm.common import small_batches, stored
from factorlake.llm.words import MIX, mixed

#: Fixed by the contract: these end a piece. All stand for the first of them in a task.
ENDS = b",.;:!?\n\x0b\x0c\r"
TO_END = bytes.maketrans(ENDS, ENDS[:1] * len(ENDS))
#: Words a task holds before it sends its stripes.
CHUNK = 1_500_000
#: Parts a stripe is dealt into by next word, so that no prefix is bound to one task.
SLOTS = 8
#: Bits of the bitmap of frequent pairs, as a power of two: 16 MB.
FILTER_BITS = 27

STRIPE = "lang string, prefix string, slot int, next array<string>, n array<long>"


def number(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def pair_bits(lang: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Place in the bitmap of a pair of words of a language, from their 64-bit numbers."""
    spread = mixed(mixed(lang * MIX[0] + left) * MIX[0] + right)
    return (spread >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Chunk:
    """Words of some texts as numbers of a vocabulary; number 0 ends a piece."""

    def __init__(self):
        self.vocabulary = defaultdict(itertools.count().__next__)
        self.vocabulary[ENDS[:1]]
        self.langs = defaultdict(itertools.count().__next__)
        self.texts, self.of, self.held = [], [], 0

    def add(self, lang: str, text: str) -> None:
        # Every end stands alone, and one more after the text.
        tokens = text.encode().lower().translate(TO_END).replace(b",", b" , ").split()
        tokens.append(b",")
        self.texts.append(np.fromiter(map(self.vocabulary.__getitem__, tokens), np.int64, len(tokens)))
        self.of.append((self.langs[lang], len(tokens)))
        self.held += len(tokens)

    def stripes(self, lengths: tuple[int, ...], frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """Stripes of the prefixes of these lengths: (lang, prefix, slot, next words, counts); next null at an end.

        Of phrases of more than two words, only those all of whose pairs are in the bitmap ``frequent``.
        """
        ids = np.concatenate(self.texts)
        lang = np.repeat([k for k, _ in self.of], [n for _, n in self.of]).astype(np.int64)
        words = list(self.vocabulary)
        texts = pa.array([None, *[w.decode() for w in words[1:]]], pa.string())
        names = pa.array(list(self.langs), pa.string())
        size = len(words)
        slots = np.fromiter(((len(w) + sum(w[-2:])) % SLOTS for w in words), np.int64, size)
        inside = ids > 0
        if frequent is not None:
            hashes = np.fromiter(map(number, words), np.uint64, size)
            own = np.fromiter((number(x.encode()) for x in self.langs), np.uint64, len(self.langs))
            bits = pair_bits(own[lang[:-1]], hashes[ids[:-1]], hashes[ids[1:]])
            linked = inside[:-1] & inside[1:] & (frequent[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).astype(bool)
        for length in lengths:
            count = len(ids) - length
            if count <= 0:
                continue
            # Words 0..length-1 of the phrase must be words; the next may be an end.
            whole = inside[:count].copy()
            for k in range(1, length):
                whole &= inside[k:count + k]
            if frequent is not None:
                for k in range(length):
                    whole &= linked[k:count + k]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            # Prefixes are numbered exactly, one word after the other.
            key = lang[at] * size + ids[at]
            for k in range(1, length):
                _, key = np.unique(key, return_inverse=True)
                key = key * size + ids[at + k]
            _, first, key = np.unique(key, return_index=True, return_inverse=True)
            entries, place, n = np.unique(key * size + ids[at + length], return_index=True, return_counts=True)
            prefix, following = entries // size, entries % size
            slot = slots[following]
            order = np.lexsort((slot, prefix))
            prefix, following, slot, n = prefix[order], following[order], slot[order], n[order]
            begins = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (slot[1:] != slot[:-1])))
            for part in range(0, len(begins), 50_000):
                rows = begins[part:part + 50_000]
                end = begins[part + 50_000] if part + 50_000 < len(begins) else len(prefix)
                where = at[first[prefix[rows]]]
                parts = [texts.take(pa.array(ids[where + k])) for k in range(length)]
                offsets = pa.array(np.append(rows, end) - rows[0], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    names.take(pa.array(lang[where])),
                    pc.binary_join_element_wise(*parts, " ") if length > 1 else parts[0],
                    pa.array(slot[rows].astype(np.int32)),
                    pa.ListArray.from_arrays(offsets, texts.take(pa.array(following[rows[0]:end]))),
                    pa.ListArray.from_arrays(offsets, pa.array(n[rows[0]:end]))],
                    names=["lang", "prefix", "slot", "next", "n"])


def filled(docs: DataFrame, lengths: tuple[int, ...], frequent: np.ndarray | None = None) -> DataFrame:
    """Stripes of every task's texts, from rows (lang, text)."""
    wanted = None if frequent is None else docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if wanted is None else wanted.value
        chunk = Chunk()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang, text in zip(langs, batch.column(1)):
                chunk.add(lang, text.as_py())
                if chunk.held > CHUNK:
                    yield from chunk.stripes(lengths, known)
                    chunk = Chunk()
        if chunk.held:
            yield from chunk.stripes(lengths, known)

    return small_batches(docs).mapInArrow(run, STRIPE)


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, total, entries): stripes of one prefix and slot meet in one task and are added elementwise.

    ``total`` counts all of them, ends included; of the entries those below ``least`` are not listed.
    """
    key = ["lang", "prefix", "slot"]
    together = stripes.repartition(*key).select(*key, F.explode(F.arrays_zip("next", "n")).alias("e"))
    added = together.groupBy(*key, F.col("e.next").alias("next")).agg(F.sum("e.n").alias("n"))
    entry = F.when(F.col("next").isNotNull() & (F.col("n") >= least), F.struct("next", "n"))
    return added.groupBy(*key).agg(F.sum("n").alias("total"), F.collect_list(entry).alias("entries"))


def _entries(stripes: DataFrame) -> DataFrame:
    return stripes.select("lang", "prefix", F.explode("entries").alias("e")).select("lang", "prefix", "e.*")


def bitmap(pairs: DataFrame) -> np.ndarray:
    """The pairs (lang, prefix, next) as a bitmap of ``2 ** FILTER_BITS`` bits, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, left, right = (np.fromiter((number(x.encode()) for x in batch.column(k).to_pylist()), np.uint64,
                                            batch.num_rows) for k in range(3))
            bits = pair_bits(own, left, right)
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 6), pa.array(np.int64(1) << (bits & 63))], names=["at", "bit"])

    words = pairs.select("lang", "prefix", "next").mapInArrow(run, "at long, bit long").groupBy("at").agg(
        F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def _phrase(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def phrases(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words with at least ``least`` occurrences, and the words of each language.

    (lang, phrase, words (array), a, right, left): the largest count of an extension by one word to either
    side, 0 if none is frequent; and (lang, n).
    """
    pairs = stored(merged(filled(docs, (1,)), least), "stripes")
    singles = stored(pairs.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("total").alias("a")), "words")
    totals = singles.groupBy("lang").agg(F.sum("a").alias("n"))
    entries = _entries(pairs)
    if longest > 2:
        # Every occurrence of a phrase passes the bitmap or none does: what comes out is counted whole.
        longer = merged(filled(docs, tuple(range(2, longest)), bitmap(entries)), least)
        entries = entries.unionByName(_entries(longer))
    entries = stored(entries.select("lang", "prefix", "next", F.col("n").alias("a"),
                                    _phrase("prefix", "next").alias("phrase")), "entries")
    right = entries.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("a").alias("right"))
    rest = F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    left = entries.groupBy("lang", rest.alias("phrase")).agg(F.max("a").alias("left"))
    known = entries.select("lang", "phrase", "a").unionByName(singles.where(F.col("a") >= least))
    found = known.join(right, ["lang", "phrase"], "left").join(left, ["lang", "phrase"], "left").select(
        "lang", "phrase", F.split("phrase", " ").alias("words"), "a",
        F.coalesce("right", F.lit(0)).alias("right"), F.coalesce("left", F.lit(0)).alias("left"))
    return stored(found, "phrases"), totals


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, subsumed: int = 80,
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    A phrase of 2 to ``longest`` words counts if it occurs ``least`` times within pieces of text. Cut after k
    words, its parts occur l and r times; ``score`` is the least floor(2000000 a / (l + r)) of all cuts, and l
    and r are those of the first such cut. A phrase goes if one that holds it has ``subsumed`` percent of its
    occurrences or more. A longer phrase never occurs more often than one within it, so it is enough to look at
    extensions by one word. Null texts count as empty, a null language as ``und``; other columns and
    identifiers are not read, and repeated rows count each. Without a phrase that qualifies, no row.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where(
        "text is not null and text <> ''")
    known, totals = phrases(rows, least, longest)
    candidates = known.where((F.size("words") > 1) & (100 * F.greatest("right", "left") < subsumed * F.col("a")))
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "words", "a", k).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("first"),
        F.array_join(F.expr("slice(words, k + 1, size(words) - k)"), " ").alias("rest"))
    counts = known.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("a").alias("c"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.withColumnRenamed("c", name), (F.col("lang") == F.col("of"))
                         & (F.col(part) == F.col("part"))).drop("of", "part", part)
    # Whole-number division of decimals of 38 digits: exact.
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (l + r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # Only the first rows of each task's part of a language go to the ranking.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", rank.cast("long")).where(
        F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

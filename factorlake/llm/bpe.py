"""Byte-level BPE over a hierarchical-bitmap rank queue.

The distinct pre-tokens of a batch that are not known yet stand one behind the other in one linked
list of bytes. Buckets, one per merge rank, hold the positions whose pair has that rank; a bitmap
of three levels of 64 bits marks the buckets that are not empty, so the next rank is three
find-first-set steps away. An entry whose pair has changed since is stale and skipped.

Merges of one pre-token never touch another, so all pre-tokens take their own merge of the lowest
rank in one step. A rank is ``calm`` if no pair that its merge can create has a lower rank;
then all its pairs are merged at once, from left to right. Otherwise each pre-token merges its
leftmost pair and the queue is asked again. Very long pre-tokens run alone, pair by pair, in
n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from factorlake.llm.common import plain

NONE = 1 << 30
#: Pre-tokens of more bytes run alone.
LONG = 256
#: Distinct pre-tokens remembered by a task before it starts anew.
KNOWN = 300_000
#: Code points handled at once: bounds memory, not the texts.
CHUNK = 2_000_000

#: The pattern of the rank file for texts made of ASCII and Latin letters, in which both forms of
#: the pattern agree; other texts take the pattern itself.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
SPACE = "\\t-\\r "
FAST = re.compile(rf" ?[{LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{SPACE}{LATIN}0-9]+"
                  rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
OTHER = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]")


class Ranks:
    """Pairs by rank, from the bytes and ranks of a rank file."""

    def __init__(self, lines: bytes):
        self.by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.size = max(self.by_bytes.values()) + 1
        self.bytes = [b""] * self.size
        self.first = np.zeros(256, np.int32)
        pairs: dict[int, int] = {}
        loud = set()
        for token, rank in self.by_bytes.items():
            self.bytes[rank] = token
            if len(token) == 1:
                self.first[token[0]] = rank
            for k in range(1, len(token)):
                left, right = self.by_bytes.get(token[:k]), self.by_bytes.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
                    loud.update(part for part in (left, right) if part >= rank)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.calm = [rank not in loud for rank in range(self.size)]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it does not merge."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], np.int32(NONE))


class Queue:
    """Buckets of positions by rank under a three-level bitmap."""

    def __init__(self, size: int):
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.put(rank, [position])
        else:
            heapq.heappush(bucket, position)

    def put(self, rank: int, positions: list[int]) -> None:
        """Fills a bucket that was empty."""
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def least(self) -> int:
        """The lowest rank with a bucket, or -1."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        return b << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Empties the bucket."""
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.mid[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.mid[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))
        return self.buckets.pop(rank)


def merge_one(data: bytes, ranks: Ranks) -> np.ndarray:
    """The ids of one pre-token, pair by pair, leftmost first among equal ranks."""
    n = len(data)
    tokens = ranks.first[np.frombuffer(data, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = ranks.pairs
    current = [pairs.get(a << 20 | b, NONE) for a, b in zip(tokens, tokens[1:])] + [NONE]
    queue = Queue(ranks.size)
    for p, rank in enumerate(current):
        if rank < NONE:
            queue.push(rank, p)
    while (rank := queue.least()) >= 0:
        bucket = queue.buckets[rank]
        p = heapq.heappop(bucket)
        if not bucket:
            queue.take(rank)
        if current[p] != rank:  # stale
            continue
        gone = after[p]
        tokens[p], after[p] = rank, after[gone]
        current[gone] = NONE
        if after[p] < n:
            before[after[p]] = p
            current[p] = pairs.get(rank << 20 | tokens[after[p]], NONE)
            if current[p] < NONE:
                queue.push(current[p], p)
        else:
            current[p] = NONE
        if (q := before[p]) >= 0:
            current[q] = pairs.get(tokens[q] << 20 | rank, NONE)
            if current[q] < NONE:
                queue.push(current[q], q)
    out, p = [], 0
    while p < n:
        out.append(tokens[p])
        p = after[p]
    return np.array(out, np.uint32)


def merge_many(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in one array, and how many each word has. No word is empty."""
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    n = int(ends[-1])
    tokens = ranks.first[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    # Position n stands behind every word; it pairs with nothing.
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[ends - 1] = n
    before[np.concatenate([[0], ends[:-1]])] = n
    alive = np.ones(n + 1, bool)
    current = np.full(n + 1, NONE, np.int32)
    inner = np.flatnonzero(after[:n] < n)
    current[inner] = ranks.of(tokens[inner], tokens[inner + 1])
    tokens = np.append(tokens, np.int32(0))
    queue = Queue(ranks.size)
    start = np.flatnonzero(current < NONE)
    order = start[np.argsort(current[start], kind="stable")]
    held = current[order]
    cuts = np.flatnonzero(np.diff(held)) + 1
    for piece in np.split(order, cuts) if len(order) else []:
        queue.put(int(current[piece[0]]), piece.tolist())

    while (rank := queue.least()) >= 0:
        at = np.array(queue.take(rank), np.int32)
        at = at[current[at] == rank]  # the others are stale
        if len(at) > 1:
            at.sort()
            at = at[np.append(True, at[1:] != at[:-1])]
            if ranks.calm[rank]:
                while len(at) > 1:  # of overlapping pairs every other one from the left
                    close = np.flatnonzero(after[at[:-1]] == at[1:]) + 1
                    if not len(close):
                        break
                    run = np.ones(len(at), bool)
                    run[close] = False
                    begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                    at = at[(np.arange(len(at)) - begin) % 2 == 0]
            else:
                own = owner[at]
                first = np.concatenate([[True], own[1:] != own[:-1]])
                later = at[~first]
                at = at[first]
                if len(later):
                    queue.put(rank, later.tolist())
        if not len(at):
            continue
        gone = after[at]
        follow = after[gone]
        tokens[at] = rank
        after[at] = follow
        before[follow] = at
        before[n] = n
        alive[gone] = False
        current[gone] = NONE
        ahead = before[at]
        current[at] = np.where(follow < n, ranks.of(tokens[at], tokens[follow]), np.int32(NONE))
        left = ahead[ahead < n]
        current[left] = ranks.of(tokens[left], tokens[after[left]])
        fresh = np.concatenate([at, left])
        fresh = fresh[current[fresh] < NONE]
        for r, p in zip(current[fresh].tolist(), fresh.tolist()):
            if (bucket := queue.buckets.get(r)) is None:
                queue.put(r, [p])
            else:
                bucket.append(p)  # sorted when it is taken
    alive[n] = False
    keep = np.flatnonzero(alive)
    return tokens[keep].astype(np.uint32), np.bincount(owner[keep], minlength=len(words))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every piece, one piece after the other."""
    total = int(counts.sum())
    shift = np.repeat(starts - np.cumsum(counts) + counts, counts)
    return shift + np.arange(total)


class Store:
    """Pieces of ids by number."""

    def __init__(self) -> None:
        self.ids, self.counts, self.starts = (np.zeros(0, t) for t in (np.uint32, np.int64, np.int64))

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids = np.concatenate([self.ids, ids])
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.concatenate([self.starts, starts])

    def get(self, numbers: np.ndarray) -> np.ndarray:
        return self.ids[spread(self.starts[numbers], self.counts[numbers])]


class Encoder:
    """Ids of texts; remembers pre-tokens until there are KNOWN of them."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = Ranks(lines)
        self.pattern = regex.compile(pattern)
        self.forget()
        lengths = np.array([len(t) for t in self.ranks.bytes], np.int64)
        self.sizes, self.places = lengths, np.cumsum(lengths) - lengths
        self.letters = np.frombuffer(b"".join(self.ranks.bytes), np.uint8)

    def forget(self) -> None:
        self.words: dict[str, int] = defaultdict(count().__next__)
        self.known = Store()

    def learn(self) -> None:
        """Encodes the pre-tokens that have come since the last call."""
        fresh = [w.encode("utf-8", "surrogatepass")
                 for w in islice(self.words, len(self.known.counts), None)]
        short = [w for w in fresh if len(w) <= LONG]
        if not fresh:
            return
        ids, counts = merge_many(short, self.ranks) if short else (np.zeros(0, np.uint32), [])
        if len(short) < len(fresh):
            pieces = iter(np.split(ids, np.cumsum(counts)[:-1]) if short else [])
            each = [next(pieces) if len(w) <= LONG else merge_one(w, self.ranks) for w in fresh]
            ids, counts = np.concatenate(each), [len(e) for e in each]
        self.known.add(ids, np.asarray(counts, np.int64))

    def split(self, text: str) -> np.ndarray:
        found = (self.pattern if OTHER.search(text) else FAST).findall(text)
        return np.fromiter(map(self.words.__getitem__, found), np.int32, len(found))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > KNOWN:
            self.forget()
        split = [self.split(t) for t in texts]
        self.learn()
        return [self.known.get(s) for s in split]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return self.letters[spread(self.places[ids], self.sizes[ids])].tobytes()


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK code points; a longer text is a range of its own."""
    begin = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield begin, k
            begin, size = k, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encode(docs: DataFrame, vocabulary: str, pattern: str, digest: bool, id_col: str,
            text_col: str) -> DataFrame:
    with open(vocabulary, "rb") as file:  # read where the job is set up; tasks get its bytes
        lines = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lines.value, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in chunks(texts):
                n, ids, decoded = [], [], []
                for found in encoder.encode(texts[begin:end]):
                    raw, back = found.astype("<u4").tobytes(), encoder.decode(found)
                    n.append(len(found))
                    ids.append(hashlib.sha256(raw).hexdigest() if digest else raw)
                    decoded.append(hashlib.sha256(back).hexdigest() if digest else back)
                kind = pa.string() if digest else pa.binary()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(n, pa.int64()),
                     pa.array(ids, kind), pa.array(decoded, kind)],
                    names=[f.split()[0] for f in (DIGESTS if digest else SCHEMA).split(", ")])

    return plain(docs, id_col, text_col).mapInArrow(run, DIGESTS if digest else SCHEMA)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded bytes of every row.

    ``vocabulary`` is a rank file that the driver can read; every match of ``pattern`` is encoded on
    its own, without special tokens. Null or empty text has no ids. Rows that repeat an
    identifier are encoded one by one; an empty table gives no row.
    """
    return _encode(docs, vocabulary, pattern, False, id_col, text_col)


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """As ``encode``, with digests in place of ids and bytes: nothing large leaves the task."""
    return _encode(docs, vocabulary, pattern, True, id_col, text_col)

"""Passages that stand elsewhere, found by an FM-index per shard.

A window is ``width`` consecutive words of one document; it is repeated if its words also start
anywhere else. To bring equal windows together without sending every window around:

1. Of the word runs of length ``GRAM`` in a window the one with the least hash is its anchor. Equal
   windows have equal anchors, and neighbouring windows mostly share theirs, so only about
   one run in thirteen words is counted. An anchor that stands once rules its windows out.
2. Every anchor that stands twice is owned by the document of the least key that has it. Windows
   in a row with the same owner form a piece of text. Pieces copied from one document
   have one owner, so a copied passage travels as a whole.
3. Pieces of one owner meet in one shard: an FM-index over them, through which they are
   streamed by backward search. Matches of ``width`` words or more are reported.

Every window is in exactly one piece and equal windows have the same owner, so counting inside
shards is exact. Owners with more words than one shard may hold are counted by window
digests instead, combined before the shuffle; both ways give the same intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlake.llm.common import plain, stored
from factorlake.llm.fm_index import FmIndex
from factorlake.llm.words import WordHash, mixed, runs_of, words_of

WIDTH = 50
GRAM = 12
#: Windows in a piece; a longer run of windows is cut into several.
PIECE = 256
#: Words of a shard, and of one owner above which its windows are counted by digest.
SHARD_WORDS = 1_000_000
OWNER_WORDS = 2_000_000


def least_in_windows(x: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours."""
    done, out = 1, x
    while done < size:
        step = min(done, size - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def anchors_of(hashes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the anchors as they stand in the text, one per place."""
    runs = runs_of(hashes, gram)
    size = width - gram + 1
    if len(runs) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = least_in_windows(runs, size)
    # Place p is an anchor if a window that covers it has its value: the windows p-size+1 .. p.
    padded = np.concatenate([np.repeat(least[:1], size - 1), least, np.repeat(least[-1:], size - 1)])
    chosen = ~least_in_windows(~padded, size) == runs  # the largest least value around p
    return least, runs[chosen]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


def _anchors(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """key, anchor, times of every document that holds a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            keys, found, times = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, places = anchors_of(hashes.of(words_of(text)), width, gram)
                if len(places):
                    values, counts = np.unique(places, return_counts=True)
                    keys.append(np.full(len(values), key, np.int64))
                    found.append(values.view(np.int64))
                    times.append(counts)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(found)),
                     pa.array(np.concatenate(times).astype(np.int32))], names=["key", "anchor", "times"])

    return docs.select("key", "text").mapInArrow(run, "key long, anchor long, times int")


def _pieces(docs: DataFrame, owners: DataFrame, width: int, gram: int) -> DataFrame:
    """owner, doc_id, key, start, n_words, text: maximal runs of windows with one owner."""
    schema = "owner long, doc_id long, key long, start long, n_words int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            rows: list[tuple] = []
            ids, keys, texts, anchors, owned = (batch.column(i).to_pylist() for i in range(5))
            for doc_id, key, text, anchor, owner in zip(ids, keys, texts, anchors, owned):
                words = words_of(text)
                least, _ = anchors_of(hashes.of(words), width, gram)
                if not len(least):
                    continue
                anchor, owner = np.array(anchor, np.int64), np.array(owner, np.int64)
                order = np.argsort(anchor)
                anchor, owner = anchor[order], owner[order]
                least = least.view(np.int64)
                at = np.minimum(np.searchsorted(anchor, least), len(anchor) - 1)
                hit = anchor[at] == least
                by = owner[at]
                change = np.flatnonzero((hit[1:] != hit[:-1]) | (by[1:] != by[:-1])) + 1
                cuts = np.concatenate([[0], change, [len(least)]]).tolist()
                for a, b in zip(cuts, cuts[1:]):
                    if hit[a]:
                        for c in range(a, b, PIECE):
                            end = min(c + PIECE, b) + width - 1
                            rows.append((int(by[a]), doc_id, key, c, end - c,
                                         b" ".join(words[c:end]).decode("utf-8", "surrogatepass")))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=[f.split()[0] for f in schema.split(", ")])

    joined = docs.join(owners, "key").select("doc_id", "key", "text", "anchors", "owners")
    return joined.mapInArrow(run, schema)


SPANS = "doc_id long, key long, start long, stop long"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                      names=["doc_id", "key", "start", "stop"])


def search_shard(rows: list[tuple[int, int, int, str]], width: int) -> list[tuple[int, int, int, int]]:
    """Spans (doc_id, key, start, stop) of repeated windows among pieces (doc_id, key, start, text)."""
    same: dict[str, list[int]] = {}
    for k, row in enumerate(rows):
        same.setdefault(row[3], []).append(k)
    numbers: dict[bytes, int] = {}
    pieces = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in words_of(t)], np.int64)
              for t in same]
    index = FmIndex(pieces)
    members = list(same.values())
    out = []
    for k, member in enumerate(members):
        if len(member) > 1:  # equal pieces are repeated throughout
            out += [(*rows[m][:2], rows[m][2], rows[m][2] + len(pieces[k])) for m in member]
    single = np.array([k for k, m in enumerate(members) if len(m) == 1], np.int64)
    for k, begin, end in index.repeats(single, width):
        doc_id, key, start, _ = rows[members[k][0]]
        out.append((doc_id, key, start + begin, start + end))
    return out


def _indexed(pieces: DataFrame, width: int) -> DataFrame:
    """Spans by FM-index: shards are runs of owners inside a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for owner, doc_id, key, start, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SHARD_WORDS and owner != last:
                    yield _spans(search_shard(held, width))
                    held, size = [], 0
                held.append((doc_id, key, start, text))
                size, last = size + n, owner
        if held:
            yield _spans(search_shard(held, width))

    return pieces.repartition("owner").sortWithinPartitions("owner").mapInArrow(run, SPANS)


def _counted(pieces: DataFrame, width: int) -> DataFrame:
    """Spans by window digests, for owners with very many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            _, ids, keys, starts, _, texts = (c.to_pylist() for c in batch.columns)
            for doc_id, key, start, text in zip(ids, keys, starts, texts):
                words = hashes.of(words_of(text))
                one, two = runs_of(words, width), runs_of(mixed(words), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(one), pa.int64()), pa.array([key] * len(one), pa.int64()),
                     pa.array(np.arange(start, start + len(one))), pa.array(one.view(np.int64)),
                     pa.array(two.view(np.int64))], names=["doc_id", "key", "start", "one", "two"])

    windows = pieces.mapInArrow(run, "doc_id long, key long, start long, one long, two long")
    again = windows.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(again, ["one", "two"]).select(
        "doc_id", "key", "start", (F.col("start") + width).alias("stop"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, key, start, stop (words, stop exclusive): together all words of repeated windows.

    ``docs`` has doc_id, key and text.
    """
    if not 1 <= gram <= width:
        raise ValueError("gram must be between 1 and width")
    anchors = stored(_anchors(docs, width, gram), "anchors")
    owners = (anchors.groupBy("anchor").agg(F.sum("times").alias("n"), F.min("key").alias("owner"))
              .where("n > 1").drop("n"))
    owners = (anchors.join(owners, "anchor").groupBy("key")
              .agg(F.collect_list("anchor").alias("anchors"), F.collect_list("owner").alias("owners")))
    pieces = stored(_pieces(docs, owners, width, gram), "pieces")
    large = (pieces.groupBy("owner").agg(F.sum("n_words").alias("words"))
             .where(F.col("words") > OWNER_WORDS).select("owner"))
    return _indexed(pieces.join(large, "owner", "left_anti"), width).unionByName(
        _counted(pieces.join(large, "owner", "left_semi"), width))


def _keep(docs: DataFrame, spans: DataFrame, digest: bool) -> DataFrame:
    schema = f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, left = [], [], []
            for text, starts, stops in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words = words_of(text)
                total.append(len(words))
                if starts:
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, starts, 1)
                    np.add.at(steps, stops, -1)
                    kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()
                    words = [words[k] for k in kept]
                removed.append(total[-1] - len(words))
                raw = b" ".join(words)
                left.append(hashlib.sha256(raw).hexdigest() if digest
                            else raw.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(left, pa.string())], names=[f.split()[0] for f in schema.split(", ")])

    grouped = spans.groupBy(F.col("doc_id").alias("id"), "key").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    same = (docs["key"] == grouped["key"]) & docs["doc_id"].eqNullSafe(grouped["id"])
    return docs.join(grouped, same, "left").select("doc_id", "text", "starts", "stops").mapInArrow(
        run, schema)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, digest: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (text; with ``digest`` kept_sha256) of every row.

    Each word in a repeated window goes, in all its places; what is left is joined by one space.
    Null or empty texts have no words. A row that repeats another, identifier and all, is a second
    place. Texts of fewer words than ``width`` stay whole. An empty table gives no row.
    """
    docs = _documents(plain(docs, id_col, text_col))
    return _keep(docs, repeated_spans(docs, width, gram), digest)

"""Exact Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows.

The Jaccard distance of shingle sets is a metric; linked documents are at most r apart. Documents of equal
sets are one class from the start.

1. The first pivots are the single shingles. A class of n shingles is at 1 - 1/n from those that it holds and
   at 1 from all others, so these are its nearest; ties go by one order of all shingles, common ones last.
   Its region is that of its first shingle. A class within r may lack the first n - ceil((1 - r) n) of them,
   so every class is replicated to the regions up to there, and two linked classes meet in one.
2. In each region one class becomes the pivot and all others are measured against it, exactly. Those within
   r are linked to it. A class linked to one of these is within 2r, and two linked classes that are both
   farther than r are found among the far ones. So a region splits into the pivot's cell (to r), with the
   boundary (from r to 2r) replicated to it, and the far rest, boundary included, which is again a region
   and gets a pivot of its own.
   Most pairs need no measuring: the shingles of a class in equal parts of the space are counted, the more parts
   the larger it is, and these profiles are never farther apart than the sets themselves.
3. Cells of one pivot are the same cell in whatever region they arose. In it only classes of different
   components have to be compared, and a boundary class at distance d only with those beyond d - r.
4. Small far regions are compared pair by pair, large ones split again, and what the last round leaves is
   compared in blocks of profiles. All pairs that profiles leave possible are measured.

Which shingles are common is told by a bounded sample; it decides what is compared in vain, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.llm.blocks import FEW, crossed, few_pairs, placed_in_blocks, sides, sizes_allow
from factorlake.llm.common import plain, small_batches, stored
from factorlake.llm.components import components
from factorlake.llm.words import WordHash, lower_words, shingles
from factorlake.session import durable

#: Documents that tell which shingles are common: those of so many of them. Bounds of the fit only.
SAMPLE = 4_000
COMMON = 4
LISTED = 200_000
#: Rounds of pivots before the rest is compared in blocks.
ROUNDS = 2
#: Parts of the profile of a class of up to so many shingles; twice as many for twice the shingles.
PARTS, PART_SIZE = 256, 8
#: Bits of the filter of texts whose sets are wanted, as a power of two: 16 MB, whatever their number.
FILTER_BITS = 27


def window(n: int, percent: int) -> int:
    """How many of its first shingles a class has to stand by."""
    return n + (-percent * n) // 100 + 1


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that many documents of a sample hold, the most frequent last; at most ``LISTED``."""
    rows = docs.count()
    share = min(1.0, SAMPLE / max(1, rows))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", F.octet_length("text")), F.lit(1_000_000))
    sample = docs.where(place < share * 1_000_000).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for text in batch.column(0):
                found = shingles(hashes.of(lower_words(text.as_py())), k)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["shingle"])

    counts = small_batches(sample).mapInArrow(run, "shingle long").groupBy("shingle").count().where(
        F.col("count") >= COMMON)
    top = counts.orderBy(F.desc("count"), "shingle").limit(LISTED).select("shingle").toArrow()
    return top.column(0).to_numpy().view(np.uint64)[::-1]


def profile_of(found: np.ndarray) -> bytes:
    """How many shingles lie in each part of the space. Counts stop at 255, far above what a part holds."""
    bits = (PARTS - 1).bit_length() + max(0, (len(found) - 1) // (PARTS * PART_SIZE)).bit_length()
    parts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(parts, 255).astype(np.uint8).tobytes()


def profiles_apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Summed differences of profiles, pair by pair; the finer one of a pair is added up to the coarser."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(left, right)]).reshape(-1, 2)
    out = np.zeros(len(left), np.int64)
    for pair in np.unique(sizes, axis=0):
        rows = np.flatnonzero((sizes == pair).all(1))
        one, other = (np.frombuffer(b"".join([side[k] for k in rows]), np.uint8).reshape(len(rows), -1).astype(np.int32)
                      for side in (left, right))
        width = int(min(pair))
        one, other = (m.reshape(len(rows), width, -1).sum(2) for m in (one, other))
        out[rows] = np.abs(one - other).sum(1)
    return out


ROWS = "doc_id long, mark long, n_shingles long, set binary, first array<long>, profile binary"


def sketched(docs: DataFrame, percent: int, k: int, common: np.ndarray) -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the set, the shingles by which it stands and its profile;
    the last three are null without words."""
    order = np.argsort(common)
    known, rank = common[order], order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            sizes, digests, firsts, profiles = [], [], [], []
            for text in batch.column(1):
                found = shingles(hashes.of(lower_words(text.as_py())), k)
                sizes.append(len(found))
                digests.append(hashlib.sha256(found.tobytes()).digest()[:16] if len(found) else None)
                if not len(found):
                    firsts.append(None)
                    profiles.append(None)
                    continue
                profiles.append(profile_of(found))
                wanted = window(len(found), percent)
                if len(known):
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    late = known[at] == found
                    rare = found[~late]
                    if len(rare) < wanted:
                        others = found[late][np.argsort(rank[at[late]])]
                        rare = np.concatenate([rare, others])
                    found = rare
                firsts.append(found[:wanted].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(firsts, pa.list_(pa.int64())), pa.array(profiles, pa.binary())],
                names=["doc_id", "mark", "n_shingles", "set", "first", "profile"])

    return small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))).mapInArrow(run, ROWS)


def _filter(marks: DataFrame) -> np.ndarray:
    """The hashes ``mark`` as a bitmap of fixed size: what is wanted is in it, and little else."""
    places = marks.select(F.shiftrightunsigned("mark", 64 - FILTER_BITS).alias("b"))
    words = places.selectExpr("shiftright(b, 6) AS at", "shiftleft(1L, CAST(b & 63 AS INT)) AS bit")
    rows = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint8)


def full_sets(classes: DataFrame, wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """id, n, shingles (sorted, 8 bytes each) of the wanted classes, read from the row that stands for each.

    All texts pass by; only those whose hash is in the filter are taken apart and shuffled.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mark").alias("key")
    asked = stored(classes.join(wanted, "id").select("id", "set", "rep.*").select("id", "set", "mark", key), "asked")
    bits = docs.sparkSession.sparkContext.broadcast(_filter(asked.select("mark")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHash(), bits.value
        for batch in batches:
            at = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            here = np.flatnonzero(known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            digests, sizes, found = [], [], []
            for row in here.tolist():
                own = shingles(hashes.of(lower_words(batch.column(2)[row].as_py())), k)
                digests.append(hashlib.sha256(own.tobytes()).digest()[:16])
                sizes.append(len(own))
                found.append(own.tobytes())
            rows = pa.array(here)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                 pa.array(found, pa.binary())], names=["key", "digest", "n", "shingles"])

    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").select(key, "mark", "text")
    texts = small_batches(marked).mapInArrow(run, "key string, digest binary, n long, shingles binary")
    # Rows listed twice give one set; they meet where the join needs them.
    return texts.dropDuplicates(["key"]).join(asked.drop("mark"), "key").where("digest = set").select("id", "n", "shingles")


def _with_profiles(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"),
                                          F.col("profile").alias(f"profile_{side}")), side)
    return pairs


def alike(apart: Column, sizes: Column, percent: int) -> Column:
    """May sets reach ``percent`` whose profiles are ``apart`` and whose sizes add up to ``sizes``?

    At a distance of D two sets differ in D / (2 - D) of their summed sizes; profiles differ in no more.
    """
    return apart * (100 + percent) <= (100 - percent) * sizes


def near_by_profile(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may reach ``percent`` by sizes and profiles, with ``apart`` and ``sizes``."""
    profiled = _with_profiles(pairs, classes)
    possible = profiled.where(sizes_allow(F.least("n_a", "n_b"), F.greatest("n_a", "n_b"), percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = profiles_apart(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            keep = pa.array(apart * (100 + percent) <= (100 - percent) * batch.column(2).to_numpy())
            columns = [batch.column(0), batch.column(1), pa.array(apart), batch.column(2)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["a", "b", "apart", "sizes"])

    return small_batches(possible.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("sizes"), "profile_a", "profile_b")
                         ).mapInArrow(run, "a long, b long, apart long, sizes long")


def block_pairs(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of different components of the large cells that sizes and profiles leave possible."""
    placed = placed_in_blocks(rows).join(classes.select("id", "n", "profile"), "id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, y = sides(group)
        names, root, n = group["id"].to_numpy(), group.root.to_numpy(), group.n.to_numpy()
        # By number of parts: (rows in order of size, profiles, or these added up to half as many parts).
        width = group.profile.map(len).to_numpy()
        levels = {}
        for parts in np.unique(width).tolist():
            rows = np.flatnonzero(width == parts)
            own = np.frombuffer(b"".join(group.profile.iloc[rows]), np.uint8).reshape(len(rows), parts).astype(np.int32)
            levels[parts] = dict(zip(rows.tolist(), own))
        second = {}
        for parts in levels:
            rows = y[width[y] == parts]
            rows = rows[np.argsort(n[rows], kind="stable")]
            if len(rows):
                second[parts] = rows, n[rows], np.stack([levels[parts][k] for k in rows.tolist()])
        halves = {parts: m.reshape(len(rows), -1, 2).sum(2) for parts, (rows, _, m) in second.items()}
        out = []
        for row in x.tolist():
            mine, parts = levels[int(width[row])][row], int(width[row])
            for other, profile, own in ((parts, None, mine), (2 * parts, halves.get(2 * parts), mine),
                                        (parts // 2, None, mine.reshape(-1, 2).sum(1))):
                if other not in second:
                    continue
                rows, size, whole = second[other]
                # Only sizes near enough meet.
                lo, hi = (np.searchsorted(size, -(-percent * n[row] // 100)),
                          np.searchsorted(size, 100 * n[row] // percent, "right"))
                there = np.arange(lo, hi)[root[rows[lo:hi]] != root[row]]
                apart = np.abs((whole if profile is None else profile)[there] - own).sum(1)
                near = rows[there][apart * (100 + percent) <= (100 - percent) * (size[there] + n[row])]
                out.append(np.stack([np.full(len(near), names[row]), names[near]], 1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, 1), axis=0)
        return pd.DataFrame({"a": pairs[:, 1], "b": pairs[:, 0]})

    return placed.select("cell", "i", "j", "of_main", "first", "id", "root", "n", "profile").groupBy(
        "cell", "of_main", "i", "j").applyInPandas(run, "a long, b long").distinct()


def measured(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """a, b, common, union of pairs of classes, from their full sets."""
    for side in ("a", "b"):
        pairs = pairs.join(full.select(F.col("id").alias(side), F.col("shingles").alias(f"set_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, union = [], []
            for s, t in zip(batch.column(2), batch.column(3)):
                both = np.concatenate([np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)])
                both.sort()
                common.append(int((both[1:] == both[:-1]).sum()))
                union.append(len(both) - common[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64()),
                                              pa.array(union, pa.int64())], names=["a", "b", "common", "union"])

    return small_batches(pairs.select("a", "b", "set_a", "set_b")).mapInArrow(
        run, "a long, b long, common long, union long")


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(100 * F.col("common") >= percent * F.col("union")).select("a", "b")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn(
        "root", F.coalesce("root", "id"))


def _cells(pairs: DataFrame, roots: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Rows (cell, id, root, n) of the pivots' cells that have a boundary class of another component.

    The distance of a class that was not measured is that of its profile, or more. A boundary class at distance d
    meets only classes at least d - r from the pivot: those of the cell below the nearest boundary's window stay out.
    """
    r = (100 - percent) / 100
    told = 2 * F.col("apart") / (F.col("sizes") + F.col("apart"))
    distance = F.coalesce(1 - F.col("common") / F.col("union"), told)
    # A margin for the rounding of quotients: windows may only be too wide.
    near = pairs.select(F.col("b").alias("pivot"), F.col("a").alias("id"), distance.alias("d")).where(
        F.col("d") <= 2 * r + 1e-9)
    rooted = _with_roots(near, roots).join(
        roots.select(F.col("node").alias("pivot"), F.col("root").alias("own")), "pivot", "left").withColumn(
        "stranger", F.col("root") != F.coalesce("own", "pivot"))
    strangers = rooted.where("stranger").groupBy("pivot").agg((F.min("d") - r - 1e-9).alias("least"))
    kept = rooted.join(strangers, "pivot").where(F.col("stranger") | (F.col("d") >= F.col("least")))
    return kept.select(F.concat(F.lit("p"), F.col("pivot")).alias("cell"), "id", "root").join(sizes, "id")


def classes_and_links(docs: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with the digest of their set; classes (id, set, rep, least, n); links (a, b) that join all components."""
    rows = stored(sketched(docs, percent, k, common_shingles(docs, k)), "first-shingles")
    classes = stored(rows.where("set is not null").groupBy("set").agg(
        F.min(F.struct("doc_id", "mark")).alias("rep"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"),
        F.first("first").alias("first"), F.first("profile").alias("profile")).withColumn(
            "id", F.monotonically_increasing_id()), "classes")
    sizes = classes.select("id", "n")
    every = classes.select(F.explode("first").alias("region"), "id")
    live = every.groupBy("region").count().where("count > 1").select("region")
    regions = stored(every.join(live, "region"), "regions")

    def sets_of(asked: DataFrame) -> DataFrame:
        ids = asked.select(F.col("a").alias("id")).unionByName(asked.select(F.col("b").alias("id"))).distinct()
        return stored(full_sets(classes, ids, docs, k), "sets")

    links, pairs, left = None, None, []
    for turn in range(ROUNDS):
        pivots = regions.groupBy("region").agg(F.min("id").alias("pivot"))
        met = regions.join(pivots, "region").where("id <> pivot")
        # Those that may be within 2r; those that may be within r are measured.
        near = stored(near_by_profile(met.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(),
                                      classes, 2 * percent - 100), "near-pivots")
        asked = near.where(alike(F.col("apart"), F.col("sizes"), percent)).select("a", "b")
        new = stored(near.join(measured(asked, sets_of(asked)), ["a", "b"], "left"), "distances")
        pairs = new if pairs is None else pairs.unionByName(new)
        links = _linked(pairs, percent)
        roots = durable(components(links))
        within = _linked(new, percent).withColumns({"close": F.lit(True)})
        far = met.join(within, (F.col("id") == F.col("a")) & (F.col("pivot") == F.col("b")), "left").where(
            "close is null").select("region", "id")
        rooted = stored(_with_roots(far, roots), "far")
        alive = rooted.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                             F.count("*").alias("rows")).where("low <> high")
        alive = stored(rooted.join(alive.select("region", "rows"), "region"), "alive")
        small = F.col("rows") * F.col("rows") <= FEW
        last = turn == ROUNDS - 1
        left.append(alive.where(F.lit(True) if last else small).select(
            F.concat(F.lit(f"{turn}:"), F.col("region")).alias("cell"), "id"))
        regions = alive.where(~small).select("region", "id")
        if last or regions.isEmpty():
            break

    cells = _cells(pairs, roots, sizes, percent)
    for part in left:
        cells = cells.unionByName(_with_roots(part, roots).join(sizes, "id").select("id", "cell", "root", "n"))
    cells = stored(crossed(cells), "cells")
    measured_pairs = pairs.where("common is not null")
    known = measured_pairs.select("a", "b").unionByName(
        measured_pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    few = near_by_profile(few_pairs(cells, percent), classes, percent).select("a", "b")
    fresh = stored(few.unionByName(block_pairs(cells, classes, percent)).distinct().join(known, ["a", "b"], "left_anti"),
                   "near-pairs")
    more = _linked(measured(fresh, sets_of(fresh)), percent)
    return rows, classes, links.unionByName(durable(more))


def jaccard_join(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Documents link when ``100 * intersection >= percent * union`` of their sets of k-word shingles, A-Z
    lower-cased; ``component_id`` is the smallest identifier that links lead to. Null or empty texts have no
    set and link to nothing. Rows that repeat an identifier are told apart by their texts; a null
    identifier names a component only where it has no other. An empty table gives no row.
    """
    docs = plain(docs, id_col, text_col)
    rows, classes, links = classes_and_links(docs, percent, k)
    roots = durable(components(links))
    # Null identifiers are left out by min unless there is no other.
    named = _with_roots(classes.select("id", "set", "least"), roots)
    component = named.groupBy("root").agg(F.min("least").alias("component"))
    found = rows.join(named.join(component, "root").select("set", "component"), "set", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(
        F.col("component")).alias("component_id"))

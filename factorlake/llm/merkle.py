"""Merkle manifests of a dataset as persistent path-copying trees.

Rows are the leaves of one tree per partition of the dataset, in the order of their key; the roots of
these trees are the leaves of the tree above them. Both are built in tiers: aligned blocks of
neighbours (1,024) become one node each, which are the entries of the next tier, until one is left. A
task holds one block at a time, so a partition that holds a third of all rows is as many blocks.

Every node is hashed once, when its block is built, and stored with it. All that follows reads stored nodes:
the proof of a leaf is its own sibling and those of its ancestors, and folding any leaf along its proof has to
end in the root, so an untouched leaf is verified by the same steps as a changed one.

A changed leaf makes a version. It copies the ancestors of the leaf, up to a root of its own; each copy
names its two children, of which one is the copy below and the other a node that the version shares with the
first one. Copies are stored beside the nodes, so the leaves of every version can be reached from its root. The
path above a block is handed down from tier to tier, at most 1,024 entries from each block, so versions of
one block meet only that block's path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from factorlake.llm.common import small_batches, stored

#: Levels of a block: 1,024 entries.
BITS = 10

STEP = "struct<sibling:string,left:boolean>"
STEPS = pa.list_(pa.struct([("sibling", pa.string()), ("left", pa.bool_())]))
COPIES = pa.list_(pa.struct([("hash", pa.string()), ("left", pa.string()), ("right", pa.string())]))


def joined(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 over all fields, each ``-`` if null, else its length in bytes, a colon and its value."""
    told = []
    for field in fields:
        text = field.cast("string")
        told.append(F.when(text.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*told), 256)


def above_entries(entries: list[str], size: int, bits: int) -> list[list[str]]:
    """The nodes above up to ``2 ** bits`` neighbours of a tree of ``size`` entries, level by level. If the tree
    has other blocks, the block's top stands ``bits`` levels above its entries, however few these are."""
    levels = []
    below = entries
    while len(below) > 1 or (size > 1 << bits and len(levels) < bits):
        below = [joined(*below[k:k + 2]) for k in range(0, len(below), 2)]
        levels.append(below)
    return levels


def siblings(levels: list[list[str]], at: int) -> list[tuple[str | None, bool]]:
    """(sibling or None, is it on the left) from the entry ``at`` of the lowest level up to the top."""
    steps = []
    for level in levels[:-1]:
        other = at ^ 1
        steps.append((level[other] if other < len(level) else None, other < at))
        at >>= 1
    return steps


def fold(leaf: str, steps: list[tuple[str | None, bool]]) -> list[tuple[str, str, str | None]]:
    """The ancestors (hash, left child, right child) of an entry along its path, from the bottom up. For a changed
    entry these are the copies of a version, else the nodes that are there."""
    nodes = []
    for sibling, left in steps:
        children = (leaf, None) if sibling is None else (sibling, leaf) if left else (leaf, sibling)
        leaf = joined(*[c for c in children if c is not None])
        nodes.append((leaf, *children))
    return nodes


def placed(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place from 0 within ``by``, and ``size``, the rows of ``by``.

    Rows are sorted in ranges of (by, order); a table of one row per range and group carries the counts
    of earlier ranges, so no group has to fit one task.
    """
    rows = stored(rows.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumns(
        {"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranges")
    ranges = stored(rows.groupBy(by, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n")),
                    "range-counts")
    # One row per range of a group: no more than the sort has partitions.
    group = Window.partitionBy(by)
    sums = ranges.select(by, "__range", "__first", F.sum("__n").over(group).alias("size"),
                         (F.sum("__n").over(group.orderBy("__range")) - F.col("__n")).alias("__before"))
    return rows.join(sums, [by, "__range"]).withColumn(
        "pos", F.col("__before") + F.col("__at") - F.col("__first")).drop(
        "__range", "__at", "__first", "__before")


@dataclass
class Trees:
    """Stored trees: ``tiers`` from the leaves up, each a table of blocks (tree, size, block, entries, nodes, top),
    whose ``nodes`` are the levels above the entries; ``roots`` (tree, root)."""

    tiers: list[DataFrame]
    roots: DataFrame
    bits: int

    def nodes(self) -> DataFrame:
        """(tree, level, pos, hash, left, right) of every stored node; leaves are level 0 and have no row."""
        found = []
        for tier, blocks in enumerate(self.tiers):
            levels = blocks.withColumn("below", F.concat(F.array("entries.hash"), "nodes")).select(
                "tree", "block", "below", F.posexplode("nodes").alias("k", "level")).select(
                "tree", "block", "k", F.get("below", "k").alias("below"), F.posexplode("level").alias("at", "hash"))
            found.append(levels.select(
                "tree", (F.lit(tier * self.bits + 1) + F.col("k")).alias("level"),
                (F.col("block") * F.expr(f"shiftleft(1L, greatest({self.bits - 1} - k, 0))") + F.col("at")).alias("pos"),
                "hash", F.get("below", 2 * F.col("at")).alias("left"), F.get("below", 2 * F.col("at") + 1).alias("right")))
        return reduce(DataFrame.unionByName, found)


def build(entries: DataFrame, bits: int = BITS) -> Trees:
    """Trees over rows (tree, pos, size, hash, and any others, which stay with their block)."""
    extra = [c for c in entries.columns if c not in ("tree", "size", "pos")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_pylist()
            hashes = batch.column("hashes").to_pylist()
            nodes = [above_entries(h, s, bits) for h, s in zip(hashes, sizes)]
            tops = [n[-1][0] if n else h[0] for n, h in zip(nodes, hashes)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("tree", "size", "block", "entries")),
                 pa.array(nodes, pa.list_(pa.list_(pa.string()))), pa.array(tops, pa.string())],
                names=["tree", "size", "block", "entries", "nodes", "top"])

    tiers = []
    while True:
        blocks = entries.groupBy("tree", "size", F.shiftright("pos", bits).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", *extra))).alias("entries"))
        schema = StructType(blocks.schema.fields).add("nodes", ArrayType(ArrayType(StringType()))).add("top", StringType())
        tiers.append(stored(small_batches(blocks.withColumn("hashes", F.col("entries.hash"))).mapInArrow(run, schema),
                            "nodes"))
        entries = tiers[-1].select("tree", F.col("block").alias("pos"),
                                   F.shiftright(F.col("size") + (1 << bits) - 1, bits).alias("size"),
                                   F.col("top").alias("hash"))
        extra = ["hash"]
        if entries.where("size > 1").isEmpty():
            return Trees(tiers, entries.select("tree", F.col("hash").alias("root")), bits)


def _with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Entries of blocks with their path: within the block, then what ``above`` (tree, pos, path) says of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                tree, places, hashes, nodes, path = (batch.column(c)[k].as_py() for c in range(5))
                levels = [hashes, *nodes]
                paths = [[{"sibling": s, "left": left} for s, left in siblings(levels, i)] + path
                         for i in range(len(hashes))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(hashes)), pa.array(places, pa.int64()), pa.array(paths, STEPS)],
                    names=["tree", "pos", "path"])

    joined_up = blocks.join(above.select("tree", F.col("pos").alias("block"), "path"), ["tree", "block"])
    return small_batches(joined_up.select("tree", "entries.pos", "entries.hash", "nodes", "path")).mapInArrow(
        run, f"tree string, pos long, path array<{STEP}>")


def paths_to_blocks(trees: Trees, above: DataFrame) -> DataFrame:
    """(tree, pos, path) of every block of leaves, from tier to tier; ``above`` (tree, path) is the path of
    each root."""
    paths = above.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(trees.tiers[1:]):
        paths = stored(_with_paths(blocks, paths), "paths")
    return paths


@dataclass
class Store:
    """Stored nodes of the first version: ``trees`` of the partitions, the ``forest`` over their roots, and the
    ``root`` (None without rows)."""

    trees: Trees
    forest: Trees
    root: str | None


def keep(docs: DataFrame, fields: list[Column], part: Column, key: Column, changed: Column | None = None,
         bits: int = BITS) -> Store:
    """Builds and stores the first version; changed leaves wait beside the leaves they stand for."""
    # 'v' keeps the byte order and null apart from every name.
    tree = F.coalesce(F.concat(F.lit("v"), part.cast("string")), F.lit("n"))
    rows = stored(docs.select(tree.alias("tree"), key.cast("long").alias("doc_id"), leaf_hash(*fields).alias("hash"),
                              (F.lit(None).cast("string") if changed is None else changed).alias("changed")), "leaves")
    trees = build(placed(rows, "tree", ["doc_id", "hash", "changed"]), bits)
    forest = build(placed(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"),
                                             F.col("root").alias("hash")), "tree", ["name"]), bits)
    top = forest.roots.first()
    return Store(trees, forest, None if top is None else top["root"])


VERSION = ("doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string, "
           "copied array<struct<hash:string,left:string,right:string>>")


def versions(store: Store) -> DataFrame:
    """doc_id, leaf, subroot, proof_sha256, folded_root and copied of every leaf, stored.

    The leaf, or the changed one in its place, is folded along the siblings that the store holds. For a changed
    leaf the nodes on the way are its version: ``copied`` (hash, left, right) from the leaf's parent to
    ``folded_root``, the root of the version. Other leaves copy nothing.
    """
    trees, forest = store.trees, store.forest
    start = forest.roots.select("tree", F.array().cast(f"array<{STEP}>").alias("path"))
    upper = paths_to_blocks(forest, start)
    # The entries of the forest's lowest blocks are the trees.
    in_forest = stored(_with_paths(forest.tiers[0], upper), "forest")
    names = forest.tiers[0].select("tree", F.explode("entries").alias("e")).select(
        F.col("e.pos").alias("pos"), F.col("e.name").alias("name"), F.col("e.hash").alias("subroot"))
    per_tree = in_forest.join(names, "pos").select(F.col("name").alias("tree"), "subroot", "path")
    above = stored(paths_to_blocks(trees, per_tree.select("tree", "path")), "above").join(
        per_tree.select("tree", "subroot"), "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, hashes, changed, nodes, path, subroot = (batch.column(c)[k].as_py() for c in range(6))
                levels = [hashes, *nodes]
                shared = [(step["sibling"], step["left"]) for step in path]
                proofs, roots, copies = [], [], []
                for at, (leaf, new) in enumerate(zip(hashes, changed)):
                    steps = siblings(levels, at) + shared
                    proofs.append(joined(*[s for s, _ in steps if s is not None]))
                    folded = fold(leaf if new is None else new, steps)
                    # A tree of one leaf in a forest of one tree: the leaf is the root.
                    roots.append(folded[-1][0] if folded else leaf if new is None else new)
                    copies.append([] if new is None or new == leaf else folded)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(hashes, pa.string()),
                     pa.array([subroot] * len(hashes), pa.string()), pa.array(proofs, pa.string()),
                     pa.array(roots, pa.string()), pa.array(copies, COPIES)],
                    names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root", "copied"])

    leaves = trees.tiers[0].join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
    return stored(small_batches(leaves.select("entries.doc_id", "entries.hash", "entries.changed", "nodes", "path",
                                              "subroot")).mapInArrow(run, VERSION), "versions")


def manifest(docs: DataFrame, fields: list[Column], part: Column, key: Column, changed: Column | None = None,
             nodes: bool = False, bits: int = BITS) -> DataFrame:
    """doc_id (the key), leaf, subroot, root, proof_sha256, folded_root, n_copied of every row.

    ``part`` names the tree of a row, ``fields`` are hashed to its leaf, and ``changed`` is a leaf that
    stands in its place in a version of its own (null or equal: no version). ``folded_root`` is where the
    changed, else the original leaf ends along its stored siblings: the root of that version, or the root itself;
    ``n_copied`` the nodes the version does not share, which ``nodes`` adds as ``copied``, from the leaf's
    parent to the root.

    A null part is a tree before all others. Leaves of one tree stand by key, null before all others, and rows
    that repeat a key by leaf, so that equal rows are interchangeable. An empty table gives no row.
    """
    store = keep(docs, fields, part, key, changed, bits)
    return versions(store).select(
        "doc_id", "leaf", "subroot", F.lit(store.root).cast("string").alias("root"), "proof_sha256", "folded_root",
        F.size("copied").cast("long").alias("n_copied"), *([F.col("copied.hash").alias("copied")] if nodes else []))


def tampered_leaf(docs_key: Column, n_chars: Column, others: list[Column], text: Column, every: int = 7) -> Column:
    """The leaf with one more in ``n_chars`` where ``every`` divides the CRC-32 of the decimal key, else null."""
    hit = F.crc32(docs_key.cast("string").cast("binary")) % every == 0
    return F.when(hit, leaf_hash(docs_key, *others, F.try_add(n_chars, F.lit(1)), text))

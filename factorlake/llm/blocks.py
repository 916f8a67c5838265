"""Links between different components of rows that share a cell, compared block by block.

Rows of one component need no further link. So in each cell the rows of its largest component meet only the
others, and those meet each other: a cell of one component and a few strangers costs its rows times the
strangers' blocks, not its square. Blocks are bounded by bytes and by rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of a cell that are listed as pairs instead of compared in blocks.
FEW = 1_024
#: Bytes of shingles, and rows, of one side of a block.
BLOCK_BYTES = 8 * 2 ** 20
BLOCK_ROWS = 1_000
#: Values counted in one go, and those of them that both sides have.
VALUES = 1_000_000
SLICE = 4_096


def sizes_allow(least: Column, greatest: Column, percent: int) -> Column:
    """Can sets of these sizes reach the threshold? They do at best where one holds the other."""
    return 100 * least >= percent * greatest


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of the left has in common with each of the right.

    Values are dealt into as many parts as keep one part small, however long the sets are.
    """
    parts = -(-(sum(map(len, left)) + sum(map(len, right))) // VALUES) or 1
    out = np.zeros((len(left), len(right)), np.float32)
    for part in range(parts):
        out += _common([x[x % np.uint64(parts) == part] for x in left],
                       [x[x % np.uint64(parts) == part] for x in right])
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    sizes_l, sizes_r = [len(x) for x in left], [len(x) for x in right]
    values, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row_l, row_r = np.repeat(np.arange(len(left)), sizes_l), np.repeat(np.arange(len(right)), sizes_r)
    column_l, column_r = column[:len(row_l)], column[len(row_l):]
    out = np.zeros((len(left), len(right)), np.float32)
    # Values on one side only are in no intersection; the others go through in slices.
    shared = np.flatnonzero((np.bincount(column_l, minlength=len(values)) > 0)
                            & (np.bincount(column_r, minlength=len(values)) > 0))
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    at_l, at_r = place[column_l], place[column_r]
    for begin in range(0, len(shared), SLICE):
        parts = []
        for rows, at, n in ((row_l, at_l, len(left)), (row_r, at_r, len(right))):
            inside = (at >= begin) & (at < begin + SLICE)
            part = np.zeros((n, min(SLICE, len(shared) - begin)), np.float32)
            part[rows[inside], at[inside] - begin] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def crossed(rows: DataFrame) -> DataFrame:
    """Rows (cell, id, root, n) of the cells with several components, and how these are cut.

    ``main``: is the row of the cell's largest component; ``pairs`` of different components at most;
    ``left`` and ``right``: blocks of the largest component and of the others.
    """
    parts = rows.groupBy("cell", "root").agg(F.count("*").alias("k"), (8 * F.sum("n")).alias("bytes"))
    largest = F.struct("k", "root")
    cells = parts.groupBy("cell").agg(
        F.max_by("root", largest).alias("main_root"), F.max("k").alias("main_rows"), F.sum("k").alias("rows"),
        F.max_by("bytes", largest).alias("main_bytes"), F.sum("bytes").alias("bytes")).where("rows > main_rows")

    def blocks(count: Column, size: Column) -> Column:
        return F.greatest(F.ceil(count / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES)).cast("int")

    others = F.col("rows") - F.col("main_rows")
    cut = cells.select("cell", "main_root", (others * F.col("rows")).alias("pairs"),
                       blocks(F.col("main_rows"), F.col("main_bytes")).alias("left"),
                       blocks(others, F.col("bytes") - F.col("main_bytes")).alias("right"))
    return rows.join(cut, "cell").withColumn("main", F.col("root") == F.col("main_root")).drop("main_root")


def few_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of the small cells whose components differ and whose sizes allow a link."""
    few = rows.where(F.col("pairs") <= FEW)
    left = few.select("cell", F.col("id").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"))
    right = few.where(~F.col("main")).select("cell", F.col("id").alias("b"), F.col("root").alias("root_b"),
                                             F.col("n").alias("n_b"))
    near = sizes_allow(F.least("n_a", "n_b"), F.greatest("n_a", "n_b"), percent)
    return left.join(right, "cell").where((F.col("root_a") != F.col("root_b")) & near).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def placed_in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (cell, of_main, i, j, first, id, root) of the large cells, once for every pair of blocks they belong to.

    ``of_main``: block i is of the largest component; ``first``: the row is in block i, else in block j.
    """
    many = rows.where(F.col("pairs") > FEW)
    mark = F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("left")).otherwise(F.col("right"))).cast("int")
    many = many.withColumn("own", mark)
    against = F.sequence(F.lit(0), F.col("right") - 1)
    to_others = F.transform(against, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"),
                                                        F.lit(True).alias("of_main"), F.lit(True).alias("first")))
    to_main = F.transform(F.sequence(F.lit(0), F.col("left") - 1), lambda i: F.struct(
        i.alias("i"), F.col("own").alias("j"), F.lit(True).alias("of_main"), F.lit(False).alias("first")))
    among = F.transform(against, lambda j: F.struct(
        F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j"), F.lit(False).alias("of_main"),
        (F.col("own") <= j).alias("first")))
    return many.withColumn("at", F.explode(F.when(F.col("main"), to_others).otherwise(F.concat(to_main, among)))).select(
        "cell", "id", "root", "at.*")


def sides(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks of a group; a block of others against itself is both."""
    first = group["first"].to_numpy(bool)
    x, y = np.flatnonzero(first), np.flatnonzero(~first)
    if len(group) and not group.of_main.iloc[0] and group.i.iloc[0] == group.j.iloc[0]:
        y = x
    return x, y


def block_links(rows: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the large cells; ``full`` has the shingles of every id (sorted, 8 bytes each).

    A pair of blocks gives only links that connect components, fewer than it has rows.
    """
    kind = dict(rows.dtypes)["id"]
    placed = placed_in_blocks(rows).join(full.select("id", "shingles"), "id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = group["id"].to_numpy()
        _, root = np.unique(group.root.to_numpy(), return_inverse=True)
        x, y = sides(group)
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []})
        sets = [np.frombuffer(s, np.uint64) for s in group.shingles]
        n = np.array([len(s) for s in sets])
        common = common_counts([sets[k] for k in x], [sets[k] for k in y]).astype(np.int64)
        union = n[x][:, None] + n[y][None] - common
        linked = (100 * common >= percent * union) & (root[x][:, None] != root[y][None])
        # One link for each pair of components is enough, and of these those that still connect.
        p, q = np.nonzero(linked)
        ends = np.sort(np.stack([root[x[p]], root[y[q]]], 1), 1)
        _, chosen = np.unique(ends, axis=0, return_index=True)
        parent = list(range(int(root.max()) + 1))

        def find(r: int) -> int:
            while parent[r] != r:
                parent[r] = parent[parent[r]]
                r = parent[r]
            return r

        out = []
        for c in chosen.tolist():
            r, s = find(int(ends[c, 0])), find(int(ends[c, 1]))
            if r != s:
                parent[max(r, s)] = min(r, s)
                out.append((names[x[p[c]]], names[y[q[c]]]))
        return pd.DataFrame({"a": [u for u, _ in out], "b": [v for _, v in out]})

    return placed.select("cell", "i", "j", "of_main", "first", "id", "root", "shingles").groupBy(
        "cell", "of_main", "i", "j").applyInPandas(run, f"a {kind}, b {kind}")

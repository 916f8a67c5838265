"""Near duplicates by SetSketch registers.

A register holds the least of exponentially distributed values of a set's shingles, as the
truncated logarithm to a base just above 1, so a sketch is small and two sketches merge by
their larger registers. Equal registers are about as likely as the sets are similar, so bands of
registers serve as buckets. Documents of equal sets are one class from the start.

1. In each bucket every class is paired with the bucket's first class only, and goes on with
   the one it meets most often.
2. Pairs pass if some similarity at or above the threshold is likely by the joint likelihood
   of their registers and set sizes, and are then verified on the full sets.
3. Components are built from the verified links.
4. Buckets that still hold several components are compared between components. Small ones
   give pairs, which go the same way. Large ones are cut into blocks, in which the bucket's largest
   component meets only the others; a task that holds two blocks counts common shingles of all
   their classes at once and emits only links that connect components, fewer than it has rows.

So a bucket that holds a third of all rows emits its size, not its square, and no link between
different components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlake.llm.blocks import block_links, crossed, few_pairs, sizes_allow
from factorlake.llm.common import plain, small_batches, stored
from factorlake.llm.components import components
from factorlake.llm.words import MIX, WordHash, lower_words, mixed, shingles
from factorlake.session import durable

BASE = 1.02
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
TOP = 2 ** 12 - 1
#: Elements handled at once while registers are filled.
CHUNK = 500_000
#: Log-likelihood that a pair may lack at the threshold: 4.5 standard deviations.
SLACK = 10.0

SEEDS = mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * MIX[0])


def fill(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (set, register) of sets that stand one behind the other, none of them empty."""
    least = np.empty((len(starts), REGISTERS), np.uint64)
    for r in range(REGISTERS):
        x = (values ^ SEEDS[r]) * MIX[1]
        x ^= x >> np.uint64(32)
        x *= MIX[2]
        least[:, r] = np.minimum.reduceat(x, starts)
    # Uniform to exponential to register: floor(1 - log_b x), cut to the range of a register.
    u = (least >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54
    k = np.floor(1.0 - np.log(-np.log1p(-u)) / np.log(BASE))
    return np.clip(k, 0, TOP).astype(np.uint16)


def merge(left: bytes, right: bytes) -> bytes:
    """The sketch of the union of two sets."""
    return np.maximum(np.frombuffer(left, np.uint16), np.frombuffer(right, np.uint16)).tobytes()


SKETCH = "doc_id long, mark long, n_shingles long, set binary, registers binary"


def sketches(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the set and its registers; the last two are null
    without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            sizes, digests, registers, waiting, held = [], [], [], [], 0

            def flush() -> None:
                lengths = np.array([len(s) for s in waiting])
                if len(waiting):
                    filled = fill(np.concatenate(waiting), np.cumsum(lengths) - lengths)
                    registers.extend(row.tobytes() for row in filled)
                waiting.clear()

            for text in batch.column(1):
                found = shingles(hashes.of(lower_words(text.as_py())), k)
                sizes.append(len(found))
                digests.append(hashlib.sha256(found.tobytes()).digest()[:16] if len(found) else None)
                if len(found):
                    waiting.append(found)
                    held += len(found)
                if held > CHUNK:
                    flush()
                    held = 0
            flush()
            rows = iter(registers)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()),
                 pa.array([None if d is None else next(rows) for d in digests], pa.binary())],
                names=["doc_id", "mark", "n_shingles", "set", "registers"])

    docs = plain(docs, id_col, text_col)
    return small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))).mapInArrow(run, SKETCH)


def likely(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray,
           threshold: float) -> np.ndarray:
    """Is a similarity at or above the threshold within SLACK of the most likely one?

    With set sizes known, a register of one set is above, below or equal to the other's with
    probabilities that follow from the similarity; their product over registers is the likelihood.
    Whether the sizes allow the threshold at all is for ``sizes_allow``, in integers: at equality
    the quotients here may fall short of it.
    """
    above = (left > right).sum(1).astype(np.float64)
    below = (left < right).sum(1).astype(np.float64)
    equal = REGISTERS - above - below
    u = n_left / (n_left + n_right)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    best = np.full(len(u), -np.inf)
    best_over = np.full(len(u), -np.inf)

    def chance(x: np.ndarray) -> np.ndarray:
        inside = 1 - np.clip(x, 0, 1) * (BASE - 1) / BASE
        return np.clip(-np.log(inside) / np.log(BASE), 1e-9, 1)

    grid = np.concatenate([np.linspace(0, threshold, 40, endpoint=False), np.linspace(threshold, 1, 20)])
    for j in grid:
        fit = np.minimum(j, most)
        p, q = chance(u - v * fit), chance(v - u * fit)
        value = above * np.log(p) + below * np.log(q) + equal * np.log(np.clip(1 - p - q, 1e-9, 1))
        best = np.maximum(best, value)
        if j >= threshold:
            best_over = np.maximum(best_over, value)
    return best_over >= best - SLACK


def _matrix(registers: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(registers), np.uint16).reshape(-1, REGISTERS)


def _plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b, registers_a, registers_b) whose sizes allow the threshold and that
    pass the likelihood."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            passed = likely(_matrix(rows.registers_a), _matrix(rows.registers_b),
                            rows.n_a.to_numpy(), rows.n_b.to_numpy(), percent / 100) if len(rows) else []
            yield rows.loc[passed, ["a", "b"]]

    possible = sizes_allow(F.least("n_a", "n_b"), F.greatest("n_a", "n_b"), percent)
    return pairs.where(possible).mapInPandas(run, "a binary, b binary")


def _full_sets(classes: DataFrame, wanted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """set, n, registers, shingles (sorted, 8 bytes each) of the wanted classes.

    A class is read from the row that stands for it, named by identifier and hash of the text, so that rows
    of one identifier, or of none, meet only their own class.
    """
    asked = wanted.join(classes.select("set", "rep"), "set")
    texts = docs.withColumn("mark", F.xxhash64("text")).join(
        asked, F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("mark") == F.col("rep.mark"))).select("set", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            sets, shingled = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = shingles(hashes.of(lower_words(text.as_py())), k).tobytes()
                if hashlib.sha256(raw).digest()[:16] == key:
                    sets.append(key)
                    shingled.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(shingled, pa.binary())],
                                             names=["set", "shingles"])

    # Rows listed twice give one set.
    found = small_batches(texts).mapInArrow(run, "set binary, shingles binary").dropDuplicates(["set"])
    return found.join(classes.select("set", "n", "registers"), "set")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes (a, b) whose full sets reach the threshold."""
    for side in ("a", "b"):
        pairs = pairs.join(full.select(F.col("set").alias(side), F.col("shingles").alias(f"set_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                union = np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for v in (s, t)])
                union.sort()
                common = int((union[1:] == union[:-1]).sum())
                if 100 * common >= percent * (len(union) - common):
                    links.append((x, y))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())],
                names=["a", "b"])

    return small_batches(pairs.select("a", "b", "set_a", "set_b")).mapInArrow(run, "a binary, b binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """bucket, set: one row per class and band."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(
        i, F.substring(F.col("registers"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    return classes.select("set", F.explode(bands).alias("bucket"))


def _with_registers(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("set").alias(side), F.col("n").alias(f"n_{side}"),
                                          F.col("registers").alias(f"registers_{side}")), side)
    return pairs


def _across(shared: DataFrame, full: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a bucket; enough of them to join these."""
    rooted = shared.join(roots.withColumnRenamed("node", "set"), "set", "left").join(full.select("set", "n"), "set")
    rows = durable(crossed(rooted.select(F.col("bucket").alias("cell"), F.col("set").alias("id"),
                                         F.coalesce("root", "set").alias("root"), "n")))
    links = _verified(_plausible(_with_registers(few_pairs(rows, percent), full), percent), full, percent)
    return links.unionByName(block_links(rows, full.withColumnRenamed("set", "id"), percent))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Links have ``100 * intersection >= percent * union`` on the sets of k-word shingles of the
    text with A-Z lower-cased; ``component_id`` is the smallest identifier that links lead to. Null or empty
    texts have no set, link to nothing and stay. Rows that repeat an identifier are told apart
    by their sets; a null identifier stays only where its component has no other. An empty table
    gives no row.
    """
    return _grouped(plain(docs, id_col, text_col), percent, k).drop("mark")


def _grouped(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text."""
    rows = stored(sketches(docs, k), "sketches")
    classes = stored(rows.where("set is not null").groupBy("set").agg(
        F.min(F.struct("doc_id", "mark")).alias("rep"), F.min("doc_id").alias("least"),
        F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "classes")
    buckets = _buckets(classes)
    # Buckets of one class say nothing and are left behind.
    first = buckets.groupBy("bucket").agg(F.min("set").alias("first"), F.max("set").alias("last")).where(
        "first <> last").select("bucket", "first")
    shared = stored(buckets.join(first, "bucket"), "shared")
    full = stored(_full_sets(classes, shared.select("set").distinct(), docs, k), "sets")
    # Each class is verified against the one head with which it shares most buckets.
    star = (shared.where("set <> first")
            .groupBy(F.col("set").alias("a"), F.col("first").alias("b")).agg(F.count("*").alias("shared"))
            .groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b")))
    star = _plausible(_with_registers(star, full), percent)
    links = durable(_verified(star, full, percent))
    roots = durable(components(links))
    more = durable(_across(shared, full, roots, percent))
    final = roots if more.isEmpty() else durable(components(links.unionByName(more)))

    member = classes.join(final.withColumnRenamed("node", "set"), "set", "left").select(
        "set", "least", F.coalesce("root", "set").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component"))
    named = member.join(least, "root").select("set", "component")
    found = rows.join(named, "set", "left")
    component = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return found.select("doc_id", "mark", "n_shingles", component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, all columns.

    Rows that repeat both identifier and text stay or go together.
    """
    kept = _grouped(plain(docs, id_col, text_col), percent, k).where("kept").select(
        F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (mark == F.col("__mark")),
                     "left_semi")


"""Mixing sources to target weights by weighted sampling without replacement.

Targets come from the sizes of the sources and their weights, capped at a number of epochs.
Inside a source, a target of ``e`` whole epochs and a rest takes every document ``e`` times and
spends the rest on the documents with the smallest keys ``-ln(u) / quality``: Efraimidis and
Spirakis' order, in which documents of higher quality come earlier. ``u`` is derived from the
identifier and a seed, so that a rerun agrees.

The order is a prefix sum over one source, which may hold a third of all rows. It is taken in
two steps: sums per (source, bin of keys), then prefix sums over the bins and inside each bin.
Bins are equal steps of the probability of a smaller key, averaged over ``LEVELS`` of quality;
their number follows the number of rows, so no window holds more than a few times ``BIN_ROWS``
rows, whatever the qualities are. Rows of one identifier (null is one) and one quality have one key and
stay in one bin, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.llm.common import WORD, stored
from factorlake.operators.ordered import POS, Running, cumulative, positions

BIN_ROWS = 2_000
EPOCHS = 3
#: Qualities are clamped to this range; the levels only shape the bins.
LEVELS = (0.01, 0.03, 0.1, 0.3, 1.0)
SEED = "mix-1"
HAIR = 1e-6


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_mark(text: Column) -> Column:
    """Tells texts of one identifier apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_quality(text: Column) -> Column:
    """0.1 to 1: the share of letters, digits and spaces among the bytes outside the usual marks.

    Symbol-laden text is taken later than prose. Null or empty text has 0.1.
    """
    size = F.octet_length(text)
    marks = size - F.octet_length(F.translate(text, "#*$%&|<>{}[]\\=^~_", ""))
    share = 1 - F.try_divide(4 * marks, size)
    return F.greatest(F.lit(0.1), F.coalesce(share, F.lit(0.1)))


def uniform(identifier: Column, seed: str = SEED) -> Column:
    """A number above 0 and below 1 from the MD5 digest of seed and identifier."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit("null")))
    high = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (high + 0.5) / F.lit(float(2 ** 52))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """doc_id, source, size in words, hash of the text, key and the bin value in [0, 1) of each row."""
    quality = text_quality(F.col(text_col)) if weight is None else weight
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       word_count(F.col(text_col)).alias("size"), text_mark(F.col(text_col)).alias("mark"),
                       quality.alias("quality"),
                       uniform(F.col(id_col)).alias("u"))
    quality = F.least(F.greatest(F.coalesce("quality", F.lit(LEVELS[0])), F.lit(LEVELS[0])),
                      F.lit(LEVELS[-1]))
    rows = rows.select("doc_id", "source", "size", "mark", (-F.log("u") / quality).alias("key"))
    part = 1 - sum(F.exp(-F.col("key") * level) for level in LEVELS) / len(LEVELS)
    return rows.withColumn("part", part)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes. A share above ``epochs`` times its source stops there and the excess is shared again by
    weight. The final level is found directly: a source of weight w and size s is full from
    level s * epochs / w on, so with sources in the order of that ratio, the level is what the
    full ones leave, divided by the weights of the others. Sources may be hosts: both orders are cut into ranges
    where they are more than one task may hold, and only sums over sources and the level reach the driver.
    """
    sizes = stored(sizes, "source-sizes")
    bound = sizes.count()
    place = F.struct(F.col("source").isNull().alias("none"), F.col("source").cast("binary").alias("name"))
    placed = positions(sizes.withColumns({"__all": F.lit(0), "__place": place}), ["__all"], "__place", bound)
    turn = F.pmod(F.col(POS), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(epochs))
    shares = placed.withColumn("weight", weight).withColumns(
        {"cap": cap, "ratio": cap / F.col("weight"), "__ratio": F.struct((cap / F.col("weight")).alias("ratio"), "__place")})
    whole = shares.agg(F.sum("source_size").cast("double").alias("size"), F.sum("weight").alias("weight")).first()
    shares = cumulative(shares, ["__all"], "__ratio", [Running("full", "sum", F.col("cap")),
                                                       Running("weights", "sum", F.col("weight"))], bound)
    level = ((F.lit(whole["size"]) - (F.col("full") - F.col("cap")))
             / (F.lit(whole["weight"]) - (F.col("weights") - F.col("weight"))))
    # The first source that stays below its cap sets the level; for later ones it would be lower.
    found = shares.agg(F.max(F.when(F.col("ratio") >= level, level)).alias("level")).first()["level"]
    target = F.least(F.col("cap"), F.coalesce(F.lit(found).cast("double") * F.col("weight"), F.col("cap")))
    return shares.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weight: Column | None = None,
        weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, mark (hash of the text), source_size, target, key, taken of every row.

    ``taken`` is the number of words used: whole epochs, then ``size`` once more for documents
    that begin within the rest, the last of them only as far as the rest goes. So the taken words
    of a source are its target rounded down. Null texts have size 0 and take nothing; a null
    source is a source; rows that repeat an identifier are rows of their own, in the order of
    their sizes and texts. An empty table gives no row.
    """
    rows = stored(sized(docs, id_col, text_col, source_col, weight), "sized")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"),
                                            F.count("*").alias("n"))
    goals = targets(per_source.select("source", "source_size"), weights, epochs)
    goals = goals.join(per_source.select(F.col("source").alias("s"), "n"),
                       F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goals = goals.withColumn("bins", F.ceil(F.col("n") / BIN_ROWS)).select(
        F.col("source").alias("goal_source"), "source_size", "target", "bins")
    # One row per source: Spark broadcasts it below its size threshold, else it sorts.
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("goal_source"))).withColumn(
        "bin", F.floor(F.col("part") * F.col("bins")))
    # Targets are sums of doubles: a hair below a whole number counts as that number.
    goal = F.col("target") + HAIR
    epoch = F.when(F.col("source_size") > 0,
                   F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(goal - epoch * F.col("source_size"))
    rows = rows.withColumns({"epoch": epoch, "rest": rest})

    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    earlier = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("source").alias("bin_source"), F.col("bin").alias("bin_no"),
                       F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)).alias("before"))
    inside = (Window.partitionBy("source", "bin").orderBy("key", "doc_id", "size", "mark")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(bins, F.col("source").eqNullSafe(F.col("bin_source"))
                     & (F.col("bin") == F.col("bin_no")))
    left = F.col("rest") - F.col("before") - F.col("within")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left.cast("long")))
    taken = F.col("epoch").cast("long") * F.col("size") + part
    return rows.select("doc_id", "source", "size", "mark", "source_size", "target", "key",
                       taken.alias("taken"))

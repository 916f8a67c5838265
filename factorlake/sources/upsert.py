"""Keyed upserts on Parquet tables.

``merge`` is the pure DataFrame part: base and incoming rows meet in one aggregation by
key, so there is a single shuffle, null keys match each other, duplicates inside the batch
resolve to the last row as a whole, and everything combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlake.schemas import Table

_SEQ, _BATCH, _NEXT = "__seq", "__batch", "__next"


def merge(base: DataFrame, incoming: DataFrame, keys: list[str], update: list[str],
          order: str | list[str] | None = None,
          defaults: dict[str, object] | None = None, spread: list[str] | None = None) -> DataFrame:
    """``base`` with the rows of ``incoming`` inserted or, by key, updated.

    Only the ``update`` columns of existing rows change. New rows get ``defaults`` where the
    batch has no such column. Among batch rows of one key the last in ``order`` (one or several
    ingest columns) gives all ``update`` columns, and the first the others, as if they
    came one by one; ties go by the values, so a rerun gives the same row. ``spread`` names the keys to deal the
    rows out by; they are then sorted once by all keys, and of the rows of a key, which are neighbours, one is kept.
    """
    defaults = defaults or {}
    types = dict(base.dtypes)

    def column(name: str) -> Column:
        c = F.col(name) if name in incoming.columns else F.lit(defaults.get(name))
        return c.cast(types[name]).alias(name)

    names = [order] if isinstance(order, str) else list(order or [])
    if spread:
        return _merge_sorted(base, incoming, keys, update, names, column, spread)
    sequence = F.struct(F.lit(1).alias("batch"), *[F.col(c) for c in names])
    batch = incoming.select(*[column(c) for c in base.columns], sequence.alias(_SEQ))
    # A base row sorts before every batch row.
    before = F.struct(F.lit(0).alias("batch"), *[F.lit(None).cast(incoming.schema[c].dataType).alias(c)
                                                 for c in names])
    rows = base.withColumn(_SEQ, before).unionByName(batch)
    changed = [c for c in base.columns if c in update]
    fixed = [c for c in base.columns if c not in update and c not in keys]
    picked = [pick(F.struct(*columns), F.struct(_SEQ, *columns)).alias(name)
              for name, pick, columns in (("__new", F.max_by, changed), ("__old", F.min_by, fixed)) if columns]
    merged = rows.groupBy(*keys).agg(*picked)
    parts = {**dict.fromkeys(changed, "__new"), **dict.fromkeys(fixed, "__old")}
    return merged.select(*[F.col(f"{parts[c]}.{c}").alias(c) if c in parts else F.col(c)
                           for c in base.columns])


def _merge_sorted(base: DataFrame, incoming: DataFrame, keys: list[str], update: list[str], names: list[str],
                  column: Callable[[str], Column], spread: list[str]) -> DataFrame:
    """``merge`` without an aggregation: the last row of a key among its sorted neighbours gives the ``update`` columns,
    the first one all others. No row is packed into a struct, which takes most of the time of wide rows."""
    changed = [c for c in base.columns if c in update]
    fixed = [c for c in base.columns if c not in update and c not in keys]
    ingest = [f"{_SEQ}_{k}" for k in range(len(names))]
    batch = incoming.select(*[column(c) for c in base.columns], F.lit(1).alias(_BATCH),
                            *[F.col(c).alias(a) for c, a in zip(names, ingest)])
    before = base.select("*", F.lit(0).alias(_BATCH), *[
        F.lit(None).cast(incoming.schema[c].dataType).alias(a) for c, a in zip(names, ingest)])
    # A base row sorts before every batch row.
    rows = before.unionByName(batch).repartition(*spread)
    sequence = Window.partitionBy(*keys).orderBy(_BATCH, *ingest, *changed)
    # Where the batch brings no such column, all its rows have the same value, and any order finds the first row.
    told = any(c in incoming.columns for c in fixed)
    first = Window.partitionBy(*keys).orderBy(_BATCH, *ingest, *fixed) if told else sequence
    so_far = first.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, *changed, *[F.first(c).over(so_far).alias(c) for c in fixed],
                       F.lead(_BATCH).over(sequence).alias(_NEXT))
    return rows.filter(F.col(_NEXT).isNull()).select(*base.columns)


def merge_table(table: Table, base: DataFrame, incoming: DataFrame, order: str | list[str] | None = None,
                spread: list[str] | None = None) -> DataFrame:
    return merge(base, incoming, list(table.key), list(table.update), order, dict(table.defaults), spread)

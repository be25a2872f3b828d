"""Ordered per-key computations that survive one key holding a third of the rows.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. The
functions here first count rows per key (map-side combined). If no key is larger
than ``opsframe.hotRows`` they plan the plain window. Otherwise the rows of all
hot keys are range-partitioned by (key, order, a tie-breaker) and written with
the number of their range, their piece: pieces follow the order, hold about
three quarters of the limit whatever the keys, types and ties, and are the same
for every later use. The window runs per (key, piece), and what must cross a
piece border travels in one summary row per piece.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.plans.storage import materialise

HOT_ROWS = 1_000_000
PIECE = "_piece"


def _limit(df: DataFrame, limit: int | None) -> int:
    return limit or int(df.sparkSession.conf.get("opsframe.hotRows", str(HOT_ROWS)))


@dataclass(frozen=True)
class HotKeys:
    """The keys above the limit, however many, and how many pieces their rows make."""

    keys: tuple[str, ...]
    marks: DataFrame
    pieces: int

    def split(self, df: DataFrame, order: Sequence[str]) -> DataFrame:
        """Adds ``_piece``: 0 for ordinary keys, rising along (key, ``order``) from 1 for hot ones.

        ``df`` runs once, for a written copy; the pieces are cut from that.
        """
        same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in self.keys]
        marked = df.join(self.marks, same, "left").drop(*[f"_h_{k}" for k in self.keys])
        held, _ = materialise(marked.withColumn("_tie", F.monotonically_increasing_id()), "marked")
        hot = held.where("_hot").repartitionByRange(self.pieces, *self.keys, *order, "_tie")
        cut, _ = materialise(hot.withColumn(PIECE, F.spark_partition_id() + 1).drop("_tie", "_hot"), "pieces")
        return held.where("_hot is null").drop("_tie", "_hot").withColumn(PIECE, F.lit(0)).unionByName(cut)


def find_hot(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> HotKeys | None:
    """Keys with more rows than ``limit``, or None.

    ``df`` may be any cheap superset of the rows to be split, such as the bare scan they come from.
    """
    keys = tuple(keys)
    limit = _limit(df, limit)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    total = hot.agg(F.sum("_n")).first()[0]
    if not total:
        return None
    marks, _ = materialise(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.lit(True).alias("_hot")), "hot")
    return HotKeys(keys, marks, max(2, math.ceil(total * 4 / 3 / limit)))


def split_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None = None,
              hot: HotKeys | None | str = "find") -> DataFrame | None:
    """``df`` with its ``_piece`` column, or None if no key is hot. ``hot`` reuses an earlier search."""
    found = find_hot(df, keys, limit) if hot == "find" else hot
    return None if found is None else found.split(df, order)


def _orders(order: Sequence[str], descending: bool = False) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in order]


def _attach(df: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of per-piece facts; null keys match themselves."""
    renamed = extra.select(
        *[F.col(k).alias(f"_x_{k}") for k in keys], F.col(PIECE).alias("_x_piece"),
        *[c for c in extra.columns if c not in keys and c != PIECE])
    same = [F.col(k).eqNullSafe(F.col(f"_x_{k}")) for k in keys] + [F.col(PIECE) == F.col("_x_piece")]
    return df.join(renamed, same, "left").drop("_x_piece", *[f"_x_{k}" for k in keys])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
             descending: bool = False, limit: int | None = None,
             hot: HotKeys | None | str = "find") -> DataFrame:
    """Position of each row in its key, from 1. ``order`` must be unique per key."""
    keys = list(keys)
    split = split_hot(df, keys, order, limit, hot)
    if split is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*_orders(order, descending))))
    inside = Window.partitionBy(*keys, PIECE).orderBy(*_orders(order, descending))
    before = Window.partitionBy(*keys).orderBy(
        F.desc(PIECE) if descending else F.asc(PIECE)).rowsBetween(Window.unboundedPreceding, -1)
    sizes = split.where(F.col(PIECE) > 0).groupBy(*keys, PIECE).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.withColumn("_off", F.sum("_n").over(before)).drop("_n")
    out = _attach(split.withColumn(name, F.row_number().over(inside)), offsets, keys)
    return out.withColumn(name, (F.col(name) + F.coalesce("_off", F.lit(0))).cast("long")).drop("_off", PIECE)


def neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
              name: str, following: bool = False, limit: int | None = None,
              hot: HotKeys | None | str = "find") -> DataFrame:
    """Adds ``name``: a struct of ``values`` from the previous (or following) row of the key, null at the end."""
    keys = list(keys)
    what = F.struct(*values)
    step = F.lead if following else F.lag
    split = split_hot(df, keys, order, limit, hot)
    if split is None:
        return df.withColumn(name, step(what).over(Window.partitionBy(*keys).orderBy(*_orders(order))))
    inside = Window.partitionBy(*keys, PIECE).orderBy(*_orders(order))
    across = Window.partitionBy(*keys).orderBy(PIECE)
    edge_of = F.min_by if following else F.max_by
    edges = (
        split.where(F.col(PIECE) > 0).groupBy(*keys, PIECE)
        .agg(edge_of(what, F.struct(*order)).alias("_edge"))
        .withColumn("_over", step("_edge").over(across)).drop("_edge")
    )
    out = _attach(split.withColumn(name, step(what).over(inside)), edges, keys)
    return out.withColumn(name, F.coalesce(name, "_over")).drop("_over", PIECE)


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str,
            current: bool = True, limit: int | None = None, hot: HotKeys | None | str = "find") -> DataFrame:
    """Adds ``name``: the last non-null ``value`` at (``current``) or strictly before each row of the key."""
    keys = list(keys)
    end = 0 if current else -1
    df = df.withColumn("_value", value)
    split = split_hot(df, keys, order, limit, hot)
    if split is None:
        run = Window.partitionBy(*keys).orderBy(*_orders(order)).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumn(name, F.last("_value", ignorenulls=True).over(run)).drop("_value")
    run = Window.partitionBy(*keys, PIECE).orderBy(*_orders(order)).rowsBetween(Window.unboundedPreceding, end)
    across = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    tails = (
        split.where((F.col(PIECE) > 0) & F.col("_value").isNotNull()).groupBy(*keys, PIECE)
        .agg(F.max_by("_value", F.struct(*order)).alias("_tail"))
    )
    pieces = split.where(F.col(PIECE) > 0).select(*keys, PIECE).distinct()
    tails = _attach(pieces, tails, keys).withColumn(
        "_over", F.last("_tail", ignorenulls=True).over(across)).drop("_tail")
    out = _attach(split.withColumn(name, F.last("_value", ignorenulls=True).over(run)), tails, keys)
    return out.withColumn(name, F.coalesce(name, "_over")).drop("_over", "_value", PIECE)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str,
                limit: int | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and including each row of the key."""
    keys = list(keys)
    df = df.withColumn("_value", value)
    split = split_hot(df, keys, order, limit)
    if split is None:
        run = Window.partitionBy(*keys).orderBy(*_orders(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum("_value").over(run)).drop("_value")
    run = Window.partitionBy(*keys, PIECE).orderBy(*_orders(order)).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        split.where(F.col(PIECE) > 0).groupBy(*keys, PIECE).agg(F.sum("_value").alias("_s"))
        .withColumn("_over", F.sum("_s").over(across)).drop("_s")
    )
    out = _attach(split.withColumn(name, F.sum("_value").over(run)), sums, keys)
    return out.withColumn(name, F.col(name) + F.coalesce("_over", F.lit(0))).drop("_over", "_value", PIECE)


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, size: int,
            name: str = "items", limit: int | None = None) -> DataFrame:
    """Ordered lists of at most ``size`` values: ``(keys, chunk, name)``; chunk 0, 1, … in order give the whole list."""
    keys = list(keys)
    rows = numbered(df.withColumn("_item", value), keys, order, "_rn", limit=limit)
    rows = rows.withColumn("chunk", F.floor((F.col("_rn") - 1) / F.lit(size)).cast("long"))
    grouped = rows.groupBy(*keys, "chunk").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "_item"))).alias("_list"))
    return grouped.select(*keys, "chunk", F.transform("_list", lambda s: s["_item"]).alias(name))

"""Mixing sources to target weights by cube-method balanced sampling.

Each document of a source starts with the expected number of copies ``target / source size``. The whole part
is taken for sure; the fraction is an inclusion probability. The flight moves the fractions of three documents
at a time along the null-space of two constraints, the document total and the token total, until one of them
is 0 or 1; so both totals stay as they are while all but two fractions of a group get settled. Groups are parts of
a source of bounded size; what they leave over meets in fewer groups round by round, until one is left per source. Its
last two fractions are the landing problem. Equal documents are one: of their expected copies together the whole part is sure, and
the fraction takes the flight.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.llm.common import materialise, read
from opsframe.plans.ordered import HOT_ROWS, HotKeys, numbered

#: Weights that the sources take in turn, in code point order.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's target is at most so many times its size.
MOST = 3.0
#: Documents that one group of the first round holds on average, and leftovers in one of the later rounds.
GROUP = 2_000
EDGE = 1e-9


def count_words(text: str = "text") -> Column:
    """``[^\\x20\\x09-\\x0D]+`` counted; null has none."""
    return F.expr(f"cast(coalesce(regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+'), 0) as long)")


def row_digest(*columns: str) -> Column:
    """A digest of the columns, equal for equal values only; null differs from empty."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws("\1", *parts), 256))


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], most: float) -> dict[str | None, float]:
    """Targets of the sources: shares of all sizes by weight, none above ``most`` times its size.

    What a source can't take is shared again by weight among those below their limit, until none
    is above. All at their limit, or no sizes at all, end it.
    """
    order = sorted((k for k, _ in sizes if k is not None)) + [k for k, _ in sizes if k is None]
    size = dict(sizes)
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    total, target, free = float(sum(size.values())), {}, list(order)
    while free:
        left = total - sum(target.values())
        share = sum(weight[k] for k in free)
        over = [k for k in free if left * weight[k] / share > most * size[k]]
        if not over:
            target.update({k: left * weight[k] / share for k in free})
            break
        target.update({k: most * size[k] for k in over})
        free = [k for k in free if k not in target]
    return target


def _draw(seed: int, key: int, step: int) -> float:
    """A number in [0, 1) that depends on its arguments only."""
    x = (key * 0x9E3779B97F4A7C15 + step * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 31
    x = (x * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 29
    return (x >> 11) / float(1 << 53)


def flight(p: np.ndarray, size: np.ndarray, keys: np.ndarray, seed: int) -> np.ndarray:
    """Moves fractions until at most two lie between 0 and 1; sums of p and of p * size stay."""
    p, live = p.astype(float).copy(), []
    p[p < EDGE] = 0.0
    p[p > 1 - EDGE] = 1.0
    for k in np.flatnonzero((p > 0) & (p < 1)).tolist():
        live.append(k)
        while len(live) == 3:
            a, b, c = live
            v = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], dtype=float)
            if not v.any():  # equal sizes: the document total alone binds
                v = np.array([1.0, -1.0, 0.0])
            v /= np.abs(v).max()
            q = p[live]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(v > 0, (1 - q) / v, np.where(v < 0, -q / v, np.inf)).min()
                down = np.where(v > 0, q / v, np.where(v < 0, (q - 1) / v, np.inf)).min()
            q = q + up * v if _draw(seed, int(keys[c]) ^ int(keys[a]), k) < down / (up + down) else q - down * v
            q[q < EDGE] = 0.0
            q[q > 1 - EDGE] = 1.0
            p[live] = q
            live = [i for i in live if 0 < p[i] < 1]
    return p


def land(p: np.ndarray, size: np.ndarray, swaps: int = 4) -> np.ndarray:
    """Settles the last fractions (two at most) of a source.

    Takes the choice whose token total is nearest, then the document total. While that still lies off, one taken and
    one left document of the group change places, the pair that brings the token total nearest; the document total stays.
    """
    p, open_ = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    want, docs = float((p * size).sum()), float(p[open_].sum())
    fixed = float((np.delete(p, open_) * np.delete(size, open_)).sum())
    choices = np.array(np.meshgrid(*[[0.0, 1.0]] * len(open_))).reshape(len(open_), -1).T
    p[open_] = min(choices.tolist(), key=lambda c: (abs(fixed + np.dot(c, size[open_]) - want), abs(sum(c) - docs), c))
    for _ in range(swaps):
        off = float((p * size).sum()) - want
        taken, left = np.flatnonzero(p >= 1), np.flatnonzero(p <= 0)
        if not len(taken) or not len(left) or abs(off) < 1:
            break
        left = left[np.argsort(size[left], kind="stable")]
        at = np.searchsorted(size[left], size[taken] - off)
        pairs = [np.clip(at + d, 0, len(left) - 1) for d in (-1, 0)]
        miss = np.concatenate([np.abs(off - size[taken] + size[left[j]]) for j in pairs])
        best = int(miss.argmin())
        if miss[best] >= abs(off):
            break
        p[taken[best % len(taken)]], p[left[np.concatenate(pairs)[best]]] = 0.0, 1.0
    return p


_ROW = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("slot", T.LongType()), T.StructField("row", T.BinaryType()),
    T.StructField("size", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("last", T.BooleanType()),
])


def _settle(seed: int):
    """Flight of one group, and the landing where it is its source's last."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", kind="stable").reset_index(drop=True)
        keys = np.array([int.from_bytes(x[:8], "big") for x in rows["row"]], dtype=np.uint64)
        size = rows["size"].to_numpy(dtype=float)
        p = flight(rows["p"].to_numpy(), size, keys, seed)
        rows["p"] = land(p, size) if rows["last"].iloc[0] else p
        return rows

    return run


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 17, group: int = GROUP,
) -> DataFrame:
    """How often the mix takes each document: id, row, size, source_size, target, copies, taken.

    One row per row of ``docs``; ``row`` is a digest of id, source and text, equal for equal rows only, which are
    interchangeable. Nulls: a null text has size 0, a null source is a source of its own behind all others, a null
    id is kept. A source without words has target 0, and documents without words are never taken more
    than its others. An empty table gives no rows; texts of any length are counted whole. Names of other columns don't matter. Reruns
    agree: every choice depends on the rows and ``seed``, not on partitions.

    The sources are collected (one row each). A group of the flight holds ``group`` different documents on average, however large
    its source and however many rows are equal.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        row_digest(id_col, source_col, text_col).alias("row"), count_words(f"`{text_col}`").alias("size"),
    )
    sized, _ = materialise(sized, "sizes")
    apart, _ = materialise(sized.groupBy("source", "row", "size").agg(F.count(F.lit(1)).alias("same")), "apart")
    stats = [(r.source, r.n, r.size) for r in apart.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("same")).alias("size")).collect()]
    targets = source_targets([(s, z) for s, _, z in stats], weights, most)
    slots = {s: -(-n // group) for s, n, _ in stats}
    plan = spark.createDataFrame(
        [(s, z, targets[s], targets[s] / z if z else 0.0, slots[s]) for s, _, z in stats],
        "source string, source_size long, target double, ratio double, slots long",
    )
    planned = F.broadcast(plan.withColumnRenamed("source", "s"))  # a row per source
    slot = F.pmod(F.xxhash64("row"), F.greatest("slots", F.lit(1)))
    expected = (F.col("ratio") - F.floor("ratio")) * F.col("same")  # of one row of them: exactly its fraction
    todo = apart.join(planned, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", slot.alias("slot"), "row", "size", (expected - F.floor(expected)).alias("p"), (F.col("slots") <= 1).alias("last"))
    done = None
    most_slots = max([1, *slots.values()])
    while True:
        out, _ = materialise(todo.groupBy("source", "slot").applyInPandas(_settle(seed), _ROW), "flight")
        settled = out.where("p <= 0 or p >= 1")
        done = settled if done is None else done.union(settled)
        if most_slots == 1:
            break
        most_slots = max(1, min(-(-most_slots * 2 // group), most_slots // 2))  # two leftovers from each slot
        todo = out.where("p > 0 and p < 1").withColumns(
            {"slot": F.pmod("slot", F.lit(most_slots)), "last": F.lit(most_slots == 1)})
    sure = apart.join(planned, F.col("source").eqNullSafe(F.col("s"))).select("row", "same", F.floor(expected).alias("sure"))
    picks = sure.join(done.select("row", "p"), "row").select("row", "same", (F.col("sure") + F.col("p")).cast("long").alias("picks"))
    base = sized.join(planned, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "row", "size", "source_size", "target", F.floor("ratio").alias("whole")).join(picks, "row")
    cols = ["doc_id", "row", "size", "source_size", "target"]
    more = _first(base.where("same > 1"), picks.where("same > 1"), F.col("picks"))
    both = base.where("same = 1").withColumn("extra", F.col("picks")).select(*cols, "whole", "extra").union(more.select(*cols, "whole", "extra"))
    copies = (F.col("whole") + F.col("extra")).cast("long")
    return both.select(*cols, copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def _first(rows: DataFrame, groups: DataFrame, n: Column) -> DataFrame:
    """``rows`` with ``extra``: 1 for n rows of each group of equal ones, else 0. ``groups`` has row and ``same``, how many are equal.

    Groups above ``opsframe.hotRows`` are numbered piece by piece.
    """
    limit = int(rows.sparkSession.conf.get("opsframe.hotRows", str(HOT_ROWS)))
    large = groups.where(F.col("same") > limit)
    total, hot = large.agg(F.sum("same")).first()[0], None
    if total:
        marks, _ = materialise(large.select(F.col("row").alias("_h_row"), F.lit(True).alias("_hot")), "hot")
        hot = HotKeys(("row",), marks, max(2, ceil(total * 4 / 3 / limit)))
    at = numbered(rows.withColumn("_same", F.lit(0)), ["row"], ["_same"], "_at", hot=hot)
    return at.withColumn("extra", F.when(F.col("_at") <= n, 1).otherwise(0).cast("long")).drop("_at", "_same")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies`` and ``taken`` (copies times words); these names replace columns of ``docs``.

    Rows that are equal in id, source and text share their copies out, one more or less; nulls and empty tables as in ``mix``.
    """
    shares, _ = materialise(mix(docs, id_col, text_col, source_col).groupBy("row").agg(
        F.count(F.lit(1)).alias("same"), F.min("copies").alias("low"), F.sum("copies").alias("all"), F.first("size").alias("words")), "shares")
    held = docs.select(F.struct("*").alias("doc"), row_digest(id_col, source_col, text_col).alias("row"))  # so no name can clash
    wanted = held.join(shares.where("`all` > 0"), "row")
    one = wanted.where("same = 1").withColumn("copies", F.col("all"))
    more = _first(wanted.where("same > 1"), shares.where("same > 1 and `all` > 0"), F.col("all") - F.col("low") * F.col("same"))
    more = more.withColumn("copies", F.col("low") + F.col("extra")).drop("extra")
    out = one.unionByName(more.where("copies > 0")).withColumn("taken", F.col("copies") * F.col("words"))
    return out.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c not in ("copies", "taken")], "copies", "taken")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source with weights 5, 2, 1."""
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")

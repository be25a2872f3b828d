"""Helpers shared by the corpus operators: inputs, written steps, connected components."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.plans import storage
from opsframe.plans.storage import scratch_dir

#: Spark's setting that removes a query's shuffle files once it has ended; a written step doesn't need them any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_step(df: DataFrame, name: str) -> tuple[str, int]:
    """Writes ``df`` under the scratch folder and lets its shuffle files go; returns the path and the row count."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return storage.write_step(df, name)
    finally:
        conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written and read back, with its row count."""
    path, count = write_step(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path), count


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of one table; any others are never read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def drop_step(spark: SparkSession, path: str) -> None:
    """Removes a written step of this run once a later one replaces it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """How many tasks ``rows`` rows need at ``per_task`` each; never fewer than the session's shuffles use."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b), both long: rows (node, root), root the smallest node reached.

    Alternates large-star and small-star steps until the edges form stars. Every node of an edge
    is in the result, also its own root; self-links are allowed; no edges give no rows. A step is a
    minimum per node, combined before the shuffle, and a join back to the edges, whose lookup side
    is unique, so adaptive execution may split a hot node. Each round is written, which cuts the
    lineage, and replaces the round before.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    path, _ = write_step(ends.distinct(), "links")
    nodes = spark.read.parquet(path)
    now, before = path, None
    while True:
        e = spark.read.parquet(now).where("a != b")
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        mid, _ = write_step(down, "links")
        down = spark.read.parquet(mid)
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .where("a != b").distinct()
        )
        out, _ = write_step(small, "links")
        state = spark.read.parquet(out).agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(7)))
        ).first()
        drop_step(spark, mid)
        if now != path:
            drop_step(spark, now)
        now = out
        if state == before:
            break
        before = state
    roots = spark.read.parquet(now).select(F.col("a").alias("node"), F.col("b").alias("root"))
    everyone = nodes.select(F.col("a").alias("node")).union(nodes.select(F.col("b").alias("node"))).distinct()
    return everyone.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


#: A byte of UTF-8 that is neither a Latin letter nor part of a longer character.
_GAP = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")


def pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A UTF-8 text in pieces of about ``size`` bytes that end before a gap between words; together they are the whole text."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


Query = Callable[[SparkSession, str], DataFrame]
__all__ = ["Query", "components", "drop_step", "materialise", "pieces", "read", "scratch_dir", "tasks", "write_step"]

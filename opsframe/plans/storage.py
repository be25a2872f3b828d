"""Cutting lineage on storage that outlives an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a
    machine-local folder would be invisible to the other executors.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = spark.conf.get("opsframe.scratch.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="opsframe-")
    spark.conf.set("opsframe.scratch.dir", folder)
    return folder


def write_step(df: DataFrame, name: str = "step") -> tuple[str, int]:
    """Writes ``df`` as Parquet under the scratch folder; returns the path and the row count.

    The count is observed during the write and needs no second job.
    """
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return path, int(seen.get["n"])


def drop(spark: SparkSession, path: str) -> None:
    """Removes a folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str = "step") -> tuple[DataFrame, int]:
    """Writes ``df`` once and reads it back; returns it with its row count.

    The files carry true sizes, so the next join picks its strategy from facts,
    and a lost executor costs a re-read instead of the whole history of a loop.
    """
    path, count = write_step(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path), count

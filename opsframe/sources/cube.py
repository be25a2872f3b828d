"""Pre-aggregation of all dimension subsets for one slice of time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIRST = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
_AGAIN = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.sum}


def cube_segment(df: DataFrame, dims: Sequence[str], measures: Mapping[str, tuple[str, str]], time_col: str,
                 start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Measures (name -> (sum|count|min|max, column)) for every subset of ``dims`` over [start, end).

    Rows are first aggregated by all dimensions; only those few rows are expanded
    into the 2^n subsets. ``grouping`` tells the subset.
    """
    def ntz(t: dt.datetime) -> Column:
        return F.lit(t).cast("timestamp_ntz")

    rows = df.where((F.col(time_col) >= ntz(start)) & (F.col(time_col) < ntz(end)))
    base = rows.groupBy(*dims).agg(*[_FIRST[fn](c).alias(n) for n, (fn, c) in measures.items()])
    return base.cube(*dims).agg(
        F.grouping_id().cast("int").alias("grouping"),
        *[_AGAIN[fn](n).alias(n) for n, (fn, _) in measures.items()])


def write_segment(segment: DataFrame, path: str, start: dt.datetime, end: dt.datetime) -> None:
    """Stores a segment; building the same slice again replaces it and leaves the others alone."""
    name = f"{start:%Y%m%d%H%M%S}_{end:%Y%m%d%H%M%S}"
    segment.withColumn("segment", F.lit(name)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(path)

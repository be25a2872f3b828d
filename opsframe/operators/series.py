"""Labelled time series: selection, range and instant queries, aggregators, rates and sync metrics.

Rows are samples ``(labels MAP<STRING,STRING>, ts, value)``, ``ts`` in epoch
milliseconds. A series is a distinct label map; its sorted entries serve as key.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.operators.filters import match_labels
from opsframe.plans.ordered import chunked, neighbour, running_sum

LOOKBACK_MS = 300_000
_KEY = "_series"


def millis(moment: dt.datetime | int) -> int:
    """Epoch milliseconds; naive moments are UTC."""
    if isinstance(moment, int):
        return moment
    return int(moment.replace(tzinfo=moment.tzinfo or dt.timezone.utc).timestamp() * 1000)


def step_ms(text: str | int) -> int:
    """``3s``, ``5m``, ``1h``, ``1d`` or milliseconds."""
    if isinstance(text, int):
        return text
    return int(float(text[:-1]) * {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}[text[-1]])


def samples_from(df: DataFrame, label_columns: Sequence[str], ts: str = "ts", value: str = "value",
                 metric: str = "metric") -> DataFrame:
    """A table with label columns as samples ``(metric, labels, ts, value)``."""
    names = F.array(*[F.lit(c) for c in label_columns])
    values = F.array(*[F.col(c).cast("string") for c in label_columns])
    kind = dict(df.dtypes)[ts]
    at = F.unix_millis(F.col(ts).cast("timestamp")) if kind.startswith("timestamp") else F.col(ts).cast("long")
    return df.select(F.col(metric).alias("metric"), F.map_from_arrays(names, values).alias("labels"), at.alias("ts"),
                     F.col(value).cast("double").alias("value"))


def select_series(df: DataFrame, metric: str | None, filters: Sequence[tuple[str, str, str]] = ()) -> DataFrame:
    rows = df if metric is None else df.where(F.col("metric") == metric)
    return match_labels(rows, filters).select("labels", "ts", "value")


def _entries(labels: Column) -> Column:
    return F.array_sort(F.map_entries(labels))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn(_KEY, _entries(F.col("labels"))).drop("labels")


def _unkeyed(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", F.map_from_entries(_KEY)).drop(_KEY)


# --- grid ----------------------------------------------------------------------------------------

def _on_grid(rows: DataFrame, start: int, last: int, step: int, lookback: int, payload: Sequence[str]) -> DataFrame:
    """Latest row of each series at each grid point ``start + i * step`` (i = 0..last) within the look-back.

    Samples first collapse to one row per series and grid cell, map-side. Each
    such row then serves the points up to the next one of its series, so no
    point is produced twice and nothing is range-joined. A window partition
    holds at most one row per grid cell, however many samples a series has.
    """
    cell = F.greatest(F.ceil((F.col("ts") - start) / step), F.lit(0)).cast("int")
    cells = rows.groupBy(_KEY, cell.alias("_cell")).agg(
        F.max_by(F.struct("ts", *payload), "ts").alias("_s"))
    following = F.lead("_cell").over(Window.partitionBy(_KEY).orderBy("_cell"))
    visible = F.floor((F.col("_s.ts") + lookback - start) / step).cast("int")
    upto = F.least(F.coalesce(following - 1, F.lit(last)), visible, F.lit(last))
    spans = cells.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_cell"))
    points = spans.select(_KEY, "_s", F.explode(F.sequence("_cell", "_upto")).alias("_i"))
    return points.select(_KEY, (F.lit(start) + F.col("_i").cast("long") * step).alias("point"),
                         F.col("_s.ts").alias("ts"), *[F.col(f"_s.{c}").alias(c) for c in payload])


def _bounds(start: dt.datetime | int, end: dt.datetime | int, step: str | int, now: dt.datetime | int | None,
            ) -> tuple[int, int, int]:
    """(start, number of the last grid point, step): start and end cut to seconds, end capped at ``now``."""
    lo, hi = millis(start) // 1000 * 1000, millis(end) // 1000 * 1000
    if now is not None:
        hi = min(hi, millis(now) // 1000 * 1000)
    width = step_ms(step)
    return lo, (hi - lo) // width, width


def query_range(df: DataFrame, metric: str | None, start: dt.datetime | int, end: dt.datetime | int, step: str | int,
                filters: Sequence[tuple[str, str, str]] = (), now: dt.datetime | int | None = None,
                lookback: int = LOOKBACK_MS) -> DataFrame:
    """(labels, ts, value): each grid point takes the latest sample of a series within the look-back."""
    lo, last, width = _bounds(start, end, step, now)
    rows = select_series(df, metric, filters).where(F.col("ts").between(lo - lookback, lo + last * width))
    grid = _on_grid(_keyed(rows), lo, last, width, lookback, ["value"])
    return _unkeyed(grid.select(_KEY, F.col("point").alias("ts"), "value")).select("labels", "ts", "value")


def query_instant(df: DataFrame, metric: str | None, at: dt.datetime | int,
                  filters: Sequence[tuple[str, str, str]] = (), lookback: int = LOOKBACK_MS) -> DataFrame:
    """(labels, ts, value) of the latest sample of each series within the look-back; ``ts`` is the query time."""
    moment = millis(at)
    rows = select_series(df, metric, filters).where(F.col("ts").between(moment - lookback, moment))
    last = _keyed(rows).groupBy(_KEY).agg(F.max_by("value", "ts").alias("value"))
    return _unkeyed(last).select("labels", F.lit(moment).cast("long").alias("ts"), "value")


def irate(df: DataFrame, at: dt.datetime | int, range_ms: int) -> DataFrame:
    """Per series the rate from its last two samples in the range; after a counter reset the last value counts."""
    moment = millis(at)
    rows = _keyed(df.where((F.col("ts") > moment - range_ms) & (F.col("ts") <= moment)))
    newest = Window.partitionBy(_KEY).orderBy(F.desc("ts"))
    # rank <= 2 is pushed below the shuffle as a per-partition group limit
    two = rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= 2)
    pairs = two.groupBy(_KEY).agg(
        F.max(F.when(F.col("_rn") == 1, F.struct("ts", "value"))).alias("_b"),
        F.max(F.when(F.col("_rn") == 2, F.struct("ts", "value"))).alias("_a")).where(F.col("_a").isNotNull())
    rate = _rate(F.col("_a.ts"), F.col("_a.value"), F.col("_b.ts"), F.col("_b.value"))
    return _unkeyed(pairs.select(_KEY, rate.alias("value"))).select(
        "labels", F.lit(moment).cast("long").alias("ts"), "value")


def _rate(t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    return F.when(v1 < v0, v1).otherwise(v1 - v0) / ((t1 - t0) / 1000)


def irate_range(df: DataFrame, metric: str | None, start: dt.datetime | int, end: dt.datetime | int,
                step: str | int, range_ms: int, filters: Sequence[tuple[str, str, str]] = (),
                limit: int | None = None) -> DataFrame:
    """``irate`` at every grid point. Each sample carries the one before it, so a point needs one row only."""
    lo, last, width = _bounds(start, end, step, None)
    rows = _keyed(select_series(df, metric, filters).where(F.col("ts").between(lo - range_ms, lo + last * width)))
    paired = neighbour(rows, [_KEY], ["ts"], ["ts", "value"], "_prev", limit=limit)
    grid = _on_grid(paired, lo, last, width, range_ms, ["value", "_prev"])
    inside = grid.where(F.col("_prev.ts") > F.col("point") - range_ms)
    rate = _rate(F.col("_prev.ts"), F.col("_prev.value"), F.col("ts"), F.col("value"))
    return _unkeyed(inside.select(_KEY, F.col("point").alias("ts"), rate.alias("value"))).select(
        "labels", "ts", "value")


# --- aggregators ---------------------------------------------------------------------------------

_SIMPLE: dict[str, Callable[[str], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "stddev": F.stddev_pop, "stdvar": F.var_pop,
    "count": lambda c: F.count(c).cast("double"),
}


def _group(by: Sequence[str] | None, without: Sequence[str] | None) -> Column:
    if by and without:
        raise ValueError("by and without exclude each other")
    labels = F.col("labels")
    if by:
        return _entries(F.map_filter(labels, lambda k, _: k.isin(list(by))))
    if without:
        return _entries(F.map_filter(labels, lambda k, _: ~k.isin(list(without))))
    return F.array().cast("array<struct<key:string,value:string>>")


def agg_series(df: DataFrame, fn: str, arg: float | int | str | None = None, by: Sequence[str] | None = None,
               without: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Aggregates the series at each timestamp, by or without labels (neither: into one series).

    sum, min, max, avg, stddev, stdvar, count; count_values (arg = label name);
    quantile (arg = q); topk, bottomk (arg = k, whole series survive).
    """
    rows = df.withColumn("_g", _group(by, without))
    if fn in _SIMPLE:
        out = rows.groupBy("_g", "ts").agg(_SIMPLE[fn]("value").alias("value"))
    elif fn == "count_values":
        counted = rows.groupBy("_g", "ts", F.col("value").alias("_v")).agg(
            F.count(F.lit(1)).cast("double").alias("value"))
        text = F.regexp_replace(F.col("_v").cast("string"), r"\.0$", "")
        label = F.struct(F.lit(str(arg)).alias("key"), text.alias("value"))
        out = counted.withColumn("_g", F.array_sort(F.array_append("_g", label)))
    elif fn == "quantile":
        out = _quantile(rows, float(arg), limit)
    elif fn in ("topk", "bottomk"):
        rank = F.desc("value") if fn == "topk" else F.asc("value")
        order = Window.partitionBy("_g", "ts").orderBy(rank, F.asc("_all"))
        ranked = rows.withColumn("_all", _entries(F.col("labels"))).withColumn("_rn", F.row_number().over(order))
        return ranked.where(F.col("_rn") <= int(arg)).select("labels", "ts", "value")
    else:
        raise ValueError(f"unknown aggregator {fn}")
    return out.select(F.map_from_entries("_g").alias("labels"), "ts", "value")


def _quantile(rows: DataFrame, q: float, limit: int | None) -> DataFrame:
    """Exact interpolated quantile from counts per value; no task holds all values of a group."""
    counts = rows.groupBy("_g", "ts", "value").agg(F.count(F.lit(1)).alias("_c"))
    cumulative = running_sum(counts, ["_g", "ts"], ["value"], F.col("_c"), "_cum", limit)
    totals = counts.groupBy("_g", "ts").agg(F.sum("_c").alias("_n"))
    joined = cumulative.join(totals, ["_g", "ts"], "inner")
    place = F.lit(q) * (F.col("_n") - 1)
    low, high = F.floor(place), F.ceil(place)
    picked = joined.groupBy("_g", "ts").agg(
        F.min(F.when(F.col("_cum") > low, F.col("value"))).alias("_lo"),
        F.min(F.when(F.col("_cum") > high, F.col("value"))).alias("_hi"), F.first(place - low).alias("_w"))
    value = F.col("_lo") * (1 - F.col("_w")) + F.col("_hi") * F.col("_w")
    return picked.select("_g", "ts", value.alias("value"))


def pipeline(df: DataFrame, functions: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Applies functions in the order given; the first one is the innermost call."""
    for fn in functions:
        df = fn(df)
    return df


def to_series(df: DataFrame, tag: str | None = None, metric: str = "value", size: int = 11_000,
              limit: int | None = None) -> DataFrame:
    """(tag, series, chunk, dps): points as ordered lists of at most ``size``; the tag is a label or the metric name."""
    name = F.lit(metric) if tag is None else F.coalesce(F.try_element_at("labels", F.lit(tag)), F.lit(metric))
    rows = df.select(name.alias("tag"), F.to_json("labels").alias("series"), "ts", "value")
    return chunked(rows, ["tag", "series"], ["ts"], F.struct("ts", "value"), size, "dps", limit)


@dataclass
class SeriesQuery:
    """Metric, matchers and a chain of functions in one description."""

    metric: str
    filters: Sequence[tuple[str, str, str]] = ()
    functions: Sequence[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    step: str | int = "3s"
    lookback: int = LOOKBACK_MS

    def then(self, fn: str, *args, **kwargs) -> SeriesQuery:
        """A copy with one more aggregator around the chain."""
        more = partial(agg_series, fn=fn, arg=args[0] if args else None, **kwargs)
        return SeriesQuery(self.metric, self.filters, [*self.functions, more], self.step, self.lookback)

    def range(self, df: DataFrame, start, end, now=None) -> DataFrame:
        rows = query_range(df, self.metric, start, end, self.step, self.filters, now, self.lookback)
        return pipeline(rows, self.functions)

    def instant(self, df: DataFrame, at) -> DataFrame:
        return pipeline(query_instant(df, self.metric, at, self.filters, self.lookback), self.functions)


# --- sync metrics --------------------------------------------------------------------------------

# Form of each sync metric.
METRIC_FORM = {
    "conversionErrors": "total", "duplicateErrors": "total", "nullErrors": "total", "otherErrors": "total",
    "nErrors": "subtasks", "numRead": "subtasks", "numWrite": "subtasks", "byteRead": "subtasks",
    "byteWrite": "subtasks", "readDuration": "subtasks", "writeDuration": "subtasks", "endLocation": "subtasks",
    "startLocation": "subtasks",
}


def sync_metric(df: DataFrame, name: str, start: dt.datetime | int, end: dt.datetime | int, job: str | None = None,
                form: str | None = None, step: str | int = "3s", lookback: int = LOOKBACK_MS) -> DataFrame:
    """(job_id, value) of a sync metric, one row per job that has points; unknown names give none.

    ``max``: largest last point of the job's series; ``subtasks``: sum of the last
    points, each at least 0; ``total``: last point of the summed series.
    """
    form = form or METRIC_FORM.get(name)
    lo, last, width = _bounds(start, end, step, None)
    top = lo + last * width
    rows = df.where(F.col("metric") == name).where(F.col("ts").between(lo - lookback, top))
    if form is None:
        rows = rows.where(F.lit(False))
    if job is not None:
        rows = match_labels(rows, [("job_id", "=", job)])
    latest = _keyed(rows.withColumn("job_id", F.try_element_at("labels", F.lit("job_id")))).groupBy(
        "job_id", _KEY).agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value"))
    floor = F.greatest(F.col("value"), F.lit(0.0)).cast("long")
    if form == "max":
        return latest.groupBy("job_id").agg(F.max(floor).alias("value"))
    if form != "total":
        return latest.groupBy("job_id").agg(F.sum(floor).alias("value"))
    # the summed series ends at the last grid point that still sees a sample
    ends = latest.groupBy("job_id").agg(F.max("ts").alias("_t")).select("job_id", F.least(
        F.lit(top), F.lit(lo) + F.floor((F.col("_t") + lookback - lo) / width) * width).alias("_t"))
    seen = latest.join(ends, "job_id", "inner").where(F.col("ts") >= F.col("_t") - lookback)
    return seen.groupBy("job_id").agg(F.greatest(F.sum("value"), F.lit(0.0)).cast("long").alias("value"))


def last_location(df: DataFrame, runs: DataFrame, name: str = "endLocation", slack_ms: int = 60_000) -> DataFrame:
    """(id, location) of finished runs (id, job_id, exec_start_time, exec_end_time): the metric up to one minute after
    their end. 0 or nothing gives no row.

    Runs and samples meet in slots of time as long as the average run: n runs cover at most 3 n slots, a sample lies in one, so a
    job's samples aren't put beside all of its runs.
    """
    points = df.where(F.col("metric") == name).select(
        F.try_element_at("labels", F.lit("job_id")).alias("job_id"), _entries(F.col("labels")).alias(_KEY), "ts",
        "value")
    bounds = runs.select("id", F.col("job_id").cast("string").alias("job_id"),
                         F.unix_millis(F.col("exec_start_time").cast("timestamp")).alias("_lo"),
                         (F.unix_millis(F.col("exec_end_time").cast("timestamp")) + slack_ms).alias("_hi"))
    mean = bounds.where("_hi >= _lo").agg(F.avg(F.col("_hi") - F.col("_lo"))).first()[0]
    width = max(1, math.ceil(mean or 1))

    def slot(c: str) -> Column:
        return F.floor(F.col(c) / F.lit(width)).cast("long")

    spread = bounds.where("_hi >= _lo").withColumn("_slot", F.explode(F.sequence(slot("_lo"), slot("_hi"))))
    near = points.withColumn("_slot", slot("ts")).join(spread, ["job_id", "_slot"], "inner").where(
        F.col("ts").between(F.col("_lo"), F.col("_hi")))
    per_series = near.groupBy("id", _KEY).agg(F.max_by("value", "ts").alias("value"))
    total = per_series.groupBy("id").agg(
        F.sum(F.greatest(F.col("value"), F.lit(0.0)).cast("long")).alias("location"))
    return total.where(F.col("location") != 0)

"""Lookups, live edges, change sets and as-of joins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe import dims
from opsframe.operators.filters import filter_by
from opsframe.plans.ordered import carried, neighbour


def live_edges(edges: DataFrame, refs: DataFrame, app_type: int | None = None,
               on: Sequence[str] = ("input_table_id", "result_table_id")) -> DataFrame:
    """Edges with at least one live reference; several references still give one row."""
    live = filter_by(refs, is_deleted=0, app_type=app_type).select(*on)
    return edges.join(live, list(on), "left_semi")


def edges_with_task(edges: DataFrame, jobs: DataFrame, side: str = "child") -> DataFrame:
    """Edges with the task id of their child or parent; edges to unknown instances are dropped."""
    end = "job_id" if side == "child" else "parent_job_id"
    tasks = jobs.select(F.col("job_id").alias(end), F.col("task_id"))
    return edges.join(tasks, end, "inner")


def top_nodes(tasks: DataFrame, edges: DataFrame, flow: int | None = None) -> DataFrame:
    """Live members of one workflow (or of every workflow) that have no incoming edge."""
    members = tasks.where((F.col("flow_id") != 0) & (F.col("is_deleted") == 0))
    if flow is not None:
        members = members.where(F.col("flow_id") == flow)
    return members.join(edges.where("is_deleted = 0").select("task_id"), "task_id", "left_anti")


def lookup(df: DataFrame, steps: Sequence[tuple[DataFrame, Sequence[str], str]]) -> DataFrame:
    """Chained star lookups: (dimension, key columns, 'left' or 'inner'); dimensions must be unique by key.

    No broadcast is forced: the optimizer broadcasts a dimension by its size and
    otherwise shuffles, and adaptive execution splits a hot key of the fact side.
    """
    for dimension, on, how in steps:
        df = df.join(dimension, list(on), how)
    return df


def with_task(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Instances with name and owner of their task; instances without a task are dropped."""
    newest = tasks.groupBy("task_id").agg(F.max_by(F.struct("name", "owner_user_id"), "id").alias("_t"))
    return jobs.join(newest, "task_id", "inner").select(
        *jobs.columns, F.col("_t.name").alias("task_name"), F.col("_t.owner_user_id").alias("owner_user_id"))


def last_success(jobs: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """Newest FINISHED run per task before ``at``: partial aggregation, one row per task leaves each partition."""
    runs = jobs.where(F.col("status") == dims.STATUS["FINISHED"])
    if at is not None:
        runs = runs.where(F.col("cyc_ts") < F.lit(at).cast("timestamp_ntz"))
    best = runs.groupBy("task_id").agg(F.max_by(F.struct("id", "cyc_ts"), F.struct("cyc_ts", "id")).alias("_b"))
    return best.select("task_id", F.col("_b.id").alias("last_id"), F.col("_b.cyc_ts").alias("last_cyc_ts"))


def last_success_before(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """For every instance the newest FINISHED run of its task earlier in (cycle, id) order."""
    finished = F.when(F.col("status") == dims.STATUS["FINISHED"], F.struct("id", "cyc_ts"))
    out = carried(jobs, ["task_id"], ["cyc_ts", "id"], finished, "_last", current=False, limit=limit)
    return out.select(*jobs.columns, F.col("_last.id").alias("last_id"), F.col("_last.cyc_ts").alias("last_cyc_ts"))


def previous_run(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Each instance with id, status and version of the previous run of its task (by id)."""
    out = neighbour(jobs, ["task_id"], ["id"], ["id", "status", "version_id"], "_prev", limit=limit)
    return out.select(*jobs.columns, F.col("_prev.id").alias("prev_id"), F.col("_prev.status").alias("prev_status"),
                      F.col("_prev.version_id").alias("prev_version_id"))


def version_changes(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs whose task version differs from the run before; first runs have nothing to differ from."""
    return previous_run(jobs, limit).where(F.col("prev_version_id") != F.col("version_id"))


def diff(old: DataFrame, new: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Change set by key: insert, update, delete or unchanged, with the attributes that hold afterwards."""
    a = old.select(*key, F.struct(*cols).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*key, F.struct(*cols).alias("_new"), F.lit(True).alias("_in_new"))
    both = a.join(b, list(key), "full_outer")
    change = (
        F.when(F.col("_in_old").isNull(), "insert").when(F.col("_in_new").isNull(), "delete")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("update")
    )
    kept = F.coalesce("_new", "_old")
    return both.select(*key, change.alias("change"), *[kept[c].alias(c) for c in cols])


def dict_lookup(df: DataFrame, dictionary: DataFrame, kind: int, on: Sequence[str], value: Column,
                name: str = "dict_value") -> DataFrame:
    """First dictionary entry by sort order for each row's key, or the default row of the type.

    ``dictionary`` has (type, is_deleted, is_default, sort) and the key columns.
    """
    live = filter_by(dictionary, type=kind, is_deleted=0)
    per_key = live.groupBy(*on).agg(F.min_by(value, F.struct("sort", *on)).alias(name))
    default = live.where("is_default = 1").agg(F.min_by(value, "sort").alias("_default"))
    # one row by construction
    joined = df.join(per_key, list(on), "left").crossJoin(F.broadcast(default))
    return joined.withColumn(name, F.coalesce(name, "_default")).drop("_default")


def dict_by_dependency(dictionary: DataFrame, kind: int, depend_name: str | None = None) -> DataFrame:
    """Live entries of a type (and of what they depend on) in sort order."""
    return filter_by(dictionary, type=kind, depend_name=depend_name, is_deleted=0).orderBy("sort")


def both_directions(up: DataFrame, down: DataFrame) -> DataFrame:
    return up.unionByName(down).distinct()

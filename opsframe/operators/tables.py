"""Upserts, replacement, soft deletes and archiving as pure table-to-table functions.

Each function returns the new content of a table; writing it (overwrite of the
touched partitions, or MERGE where the format has it) is the caller's choice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe import dims


def last_by_key(new: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``; aggregated before the shuffle."""
    rest = [c for c in new.columns if c not in key]
    best = new.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*new.columns)


def upsert(base: DataFrame, new: DataFrame, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Existing rows get ``cols`` from ``new``, unknown keys are inserted whole. Both sides unique by key."""
    a, b = base.withColumn("_in_base", F.lit(True)).alias("a"), new.withColumn("_in_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full_outer")
    known, fresh = F.col("a._in_base").isNotNull(), F.col("b._in_new").isNotNull()
    out = []
    for c in base.columns:
        if c not in new.columns:
            out.append(F.col(f"a.{c}").alias(c))
        elif c in cols:
            out.append(F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
        else:
            out.append(F.when(known, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    return joined.select(*out)


def insert_new(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds rows whose key is not there yet."""
    fresh = new.dropDuplicates(list(key)).join(base.select(*key), list(key), "left_anti")
    return base.unionByName(fresh.select(*new.columns), allowMissingColumns=True)


def replace(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Whole rows of ``new`` take the place of rows with the same key."""
    kept = base.join(new.select(*key), list(key), "left_anti").select(*base.columns)
    return kept.unionByName(new, allowMissingColumns=True)


def replace_batch(edges: DataFrame, refs: DataFrame, batch: str, new: DataFrame,
                  key: Sequence[str] = ("input_table_id", "result_table_id"), app_type: int = 1,
                  default_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """Replaces the edges of one batch: its old references are soft-deleted, edges upserted, references revived.

    With ``default_key`` (no batch key given by the caller) nothing is deleted first.
    """
    pairs = new.select(*key).dropDuplicates()
    of_batch = (F.col("unique_key") == batch) & (F.col("app_type") == app_type)
    cleared = refs if default_key else refs.withColumn(
        "is_deleted", F.when(of_batch, F.lit(1)).otherwise(F.col("is_deleted")).cast("int"))
    revived = pairs.select(*key, F.lit(app_type).alias("app_type"), F.lit(batch).alias("unique_key"),
                           F.lit(0).alias("is_deleted"))
    new_refs = upsert(cleared, revived, [*key, "app_type", "unique_key"], ["is_deleted"])
    return insert_new(edges, pairs, key), new_refs


def add_edge(edges: DataFrame, refs: DataFrame, edge: DataFrame, unique_key: str, app_type: int = 1,
             key: Sequence[str] = ("input_table_id", "result_table_id")) -> tuple[DataFrame, DataFrame]:
    """Manual edges: upsert of the edge and of its reference."""
    return replace_batch(edges, refs, unique_key, edge, key, app_type, default_key=True)


def remove_edge(refs: DataFrame, edge: DataFrame, unique_key: str, app_type: int = 1,
                key: Sequence[str] = ("input_table_id", "result_table_id")) -> DataFrame:
    """Soft delete of the references of the given edges only; the edges stay."""
    gone = edge.select(*key).dropDuplicates().withColumn("_gone", F.lit(True))
    hit = F.col("_gone").isNotNull() & (F.col("unique_key") == unique_key) & (F.col("app_type") == app_type)
    return refs.join(gone, list(key), "left").withColumn(
        "is_deleted", F.when(hit, F.lit(1)).otherwise(F.col("is_deleted")).cast("int")).select(*refs.columns)


RETENTION_DAYS = {(0, 1): 15, (2,): 30, (3, 4): 60}


def expired_instances(now: dt.datetime, retention: Mapping[tuple[int, ...], int] = RETENTION_DAYS) -> Column:
    """True for instances older than the retention of their period type."""
    out = F.lit(False)
    for periods, days in retention.items():
        limit = (now - dt.timedelta(days=days)).strftime("%Y%m%d") + "000000"
        out = out | (F.col("period_type").isin(list(periods)) & (F.col("cyc_time") < limit))
    return out


def archive(jobs: DataFrame, edges: DataFrame, fills: DataFrame, now: dt.datetime,
            retention: Mapping[tuple[int, ...], int] = RETENTION_DAYS,
            edge_key: str = "job_id") -> dict[str, tuple[DataFrame, DataFrame]]:
    """(kept, archived) for instances by age, fills no kept instance refers to, and edges of archived instances."""
    old = F.coalesce(expired_instances(now, retention), F.lit(False))
    kept, gone = jobs.where(~old), jobs.where(old)
    used = kept.where("fill_id > 0").select(F.col("fill_id").alias("id")).distinct()
    gone_keys = gone.select(edge_key)
    return {
        "jobs": (kept, gone),
        "fills": (fills.join(used, "id", "left_semi"), fills.join(used, "id", "left_anti")),
        "edges": (edges.join(gone_keys, edge_key, "left_anti"), edges.join(gone_keys, edge_key, "left_semi")),
    }


def register_datasets(base: DataFrame, seen: DataFrame) -> DataFrame:
    """Get-or-create of data sets: key is source, database and table; an empty schema means the database name."""
    keyed = seen.select(
        "source_id", "db_name", F.coalesce(F.nullif(F.col("schema_name"), F.lit("")), "db_name").alias("schema_name"),
        "table_name", F.concat(F.col("source_id").cast("string"), "db_name", "table_name").alias("table_key"))
    return insert_new(base, keyed, ["table_key"])


def replace_edges(base: DataFrame, new: DataFrame, order: Sequence[str]) -> DataFrame:
    """Saves task edges: the last row per (task, parent, project) wins and replaces all old edges of its task."""
    latest = last_by_key(new, ["task_id", "parent_task_id", "project_id"], order)
    kept = base.join(new.select("task_id").distinct(), "task_id", "left_anti").select(*base.columns)
    return kept.unionByName(latest.select(*base.columns))


def mark(df: DataFrame, where: Column, changes: Mapping[str, object]) -> DataFrame:
    """Sets columns on the rows that match, e.g. read or deleted flags."""
    return df.withColumns({
        c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(dict(df.dtypes)[c])
        for c, v in changes.items()})


def expire_stale(df: DataFrame, now: dt.datetime, timeout_s: int = 100, keep_s: int = 604_800,
                 modified: str = "gmt_modified") -> DataFrame:
    """Running rows without news for ``timeout_s`` become FAILED; rows older than ``keep_s`` are purged."""
    moment = F.lit(now).cast("timestamp_ntz")
    silent = moment - F.make_dt_interval(secs=F.lit(timeout_s))
    oldest = moment - F.make_dt_interval(secs=F.lit(keep_s))
    stale = (F.col(modified) < silent) & ~F.col("status").isin(dims.STOPPED)
    return df.where(F.col(modified) >= oldest).withColumn(
        "status", F.when(stale, F.lit(dims.STATUS["FAILED"])).otherwise(F.col("status")).cast(dict(df.dtypes)["status"]))


def apply_commit(staged: DataFrame, base: DataFrame, commit: str, key: Sequence[str], cols: Sequence[str],
                 ) -> tuple[DataFrame, DataFrame]:
    """Applies the pending rows of a commit in id order (the last per key wins); returns (base, staged)."""
    pending = (F.col("commit_id") == commit) & (F.col("is_commit") == 0)
    rows = staged.where(pending)
    latest = last_by_key(rows.select("id", *key, *cols), key, ["id"]).drop("id")
    return upsert(base, latest, key, cols), mark(staged, pending, {"is_commit": 1})


def clean_plan(jobs: DataFrame, edges: DataFrame, day: dt.date, name: str = "cronJob",
               ) -> tuple[DataFrame, DataFrame]:
    """Drops the normal instances planned for a day, and their edges."""
    planned = (F.col("type") == 0) & F.col("cyc_time").startswith(day.strftime("%Y%m%d")) & F.col(
        "job_name").startswith(name)
    gone = jobs.where(planned).select("job_key")
    return jobs.where(~planned), edges.join(gone, "job_key", "left_anti")

"""Row selection: optional criteria, names, days, status groups, labels, paging."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe import dims



def filter_by(df: DataFrame, **criteria) -> DataFrame:
    """Keeps rows equal to every criterion that is not None; lists mean IN and an empty list means no filter."""
    for name, value in criteria.items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set)):
            if value:
                df = df.where(F.col(name).isin(list(value)))
        else:
            df = df.where(F.col(name) == value)
    return df


def name_matches(col: Column, text: str, mode: str | None = "fuzzy") -> Column:
    """The text is taken literally; wildcard characters in it have no meaning."""
    if mode == "precise":
        return col == text
    if mode == "front":
        return col.startswith(text)
    if mode == "tail":
        return col.endswith(text)
    return col.contains(text)


def search_name(df: DataFrame, col: str, text: str | None, mode: str | None = "fuzzy") -> DataFrame:
    return df if not text else df.where(name_matches(F.col(col), text, mode))


def dependency_candidates(tasks: DataFrame, project_id: int | None, text: str | None,
                          exclude: DataFrame | Sequence[int] = ()) -> DataFrame:
    """Submitted, live tasks outside workflows whose name holds ``text``, without the excluded ids."""
    out = filter_by(tasks, project_id=project_id, submit_status=1, is_deleted=0, flow_id=0)
    out = search_name(out, "name", text)
    if isinstance(exclude, DataFrame):
        out = out.join(exclude.select("task_id"), "task_id", "left_anti")
    elif exclude:
        out = out.where(~F.col("task_id").isin(list(exclude)))
    return out.select("task_id", "name", "owner_user_id")


def between_days(df: DataFrame, col: str, lo: dt.date | None, hi: dt.date | None) -> DataFrame:
    """Closed day range as a plain range on the column, so that files and partitions can be skipped."""
    if lo is not None:
        df = df.where(F.col(col) >= F.lit(dt.datetime.combine(lo, dt.time())).cast("timestamp_ntz"))
    if hi is not None:
        end = dt.datetime.combine(hi, dt.time()) + dt.timedelta(days=1)
        df = df.where(F.col(col) < F.lit(end).cast("timestamp_ntz"))
    return df


def visible_tasks(df: DataFrame) -> DataFrame:
    """Published rows stay visible even when deleted."""
    return df.where(F.when(F.col("is_publish_to_produce") == 0, F.col("is_deleted") == 0).otherwise(True))


def status_members(groups: Iterable[int], split: bool = False) -> list[int]:
    table = dims.SPLIT if split else dims.MERGED
    return sorted({code for g in groups for code in table.get(g, [])})


def filter_status(df: DataFrame, groups: Iterable[int], split: bool = False, col: str = "status") -> DataFrame:
    """Rows whose status belongs to one of the groups; an unknown group adds nothing.

    The member list has at most 27 codes, so it is a literal IN that reaches the scan.
    """
    groups = list(groups)
    return df if not groups else df.where(F.col(col).isin(status_members(groups, split)))


def biz_window(start: dt.date, end: dt.date) -> dict[str, str]:
    """Text bounds of a business-day window and of the cycle times that belong to it."""
    def midnight(day: dt.date, plus: int) -> str:
        return (day + dt.timedelta(days=plus)).strftime("%Y%m%d") + "000000"

    return {"biz_start": midnight(start, 0), "biz_end": midnight(end, 1),
            "cyc_start": midnight(start, 1), "cyc_end": midnight(end, 2)}


def in_biz_window(df: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    if start is None or end is None:
        return df
    w = biz_window(start, end)
    return df.where((F.col("business_date") >= w["biz_start"]) & (F.col("business_date") < w["biz_end"])
                    & (F.col("cyc_time") >= w["cyc_start"]) & (F.col("cyc_time") < w["cyc_end"]))


def self_edges(edges: DataFrame) -> DataFrame:
    """Edges between two instances of one task: equal keys up to the time tail."""
    def head(c: str) -> Column:
        return F.col(c).substr(F.lit(1), F.length(c) - 15)

    return edges.where(head("job_key") == head("parent_job_key"))


#: Fixed value: the form of a valid savepoint path.
SAVEPOINT = r"^hdfs.*[a-zA-Z0-9]{8}-[a-zA-Z0-9]{6}-[a-zA-Z0-9]{12}$"


def valid_savepoints(df: DataFrame, pattern: str = SAVEPOINT) -> DataFrame:
    return df.where(F.col("checkpoint_savepath").rlike(pattern))


def checkpoints_between(df: DataFrame, start: dt.datetime | None, end: dt.datetime | None,
                        task_id: object | None = None) -> DataFrame:
    """Live checkpoints with a save path triggered inside the closed range."""
    out = filter_by(df, is_deleted=0, task_id=task_id).where(F.col("checkpoint_savepath").isNotNull())
    if start is not None and end is not None:
        out = out.where(F.col("checkpoint_trigger").between(
            F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return out


def failed_checkpoints(df: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None,
                       task_id: object | None = None, size: int | None = None) -> DataFrame:
    """Checkpoints without a save path, newest first."""
    out = filter_by(df, task_id=task_id).where(F.col("checkpoint_savepath").isNull())
    if start is not None and end is not None:
        out = out.where(F.col("checkpoint_trigger").between(
            F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    out = out.orderBy(F.desc("checkpoint_trigger"), F.desc("id"))
    return out if size is None else out.limit(size)


def match_labels(df: DataFrame, filters: Iterable[tuple[str, str, str]], labels: str = "labels") -> DataFrame:
    """AND of (label, operator, value); operators = != =~ !~, expressions match the whole value, a missing label is ''."""
    for label, operator, value in filters:
        have = F.coalesce(F.try_element_at(F.col(labels), F.lit(label)), F.lit(""))
        whole = F.lit(f"^(?:{value})$")
        if operator == "=":
            df = df.where(have == value)
        elif operator == "!=":
            df = df.where(have != value)
        elif operator == "=~":
            df = df.where(F.rlike(have, whole))
        elif operator == "!~":
            df = df.where(~F.rlike(have, whole))
        else:
            raise ValueError(f"unknown matcher {operator}")
    return df


def audit_search(log: DataFrame, tenant_id: int | None = None, app_tag: str | None = None,
                 operator: str | None = None, start: dt.datetime | None = None, end: dt.datetime | None = None,
                 operation: str | None = None, operation_object: str | None = None) -> DataFrame:
    out = filter_by(log, tenant_id=tenant_id, app_tag=app_tag or None, operation=operation)
    out = search_name(out, "operator", operator)
    out = search_name(out, "operation_object", operation_object)
    if start is not None:
        out = out.where(F.col("gmt_create") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("gmt_create") <= F.lit(end).cast("timestamp_ntz"))
    return out


PROFILES: Mapping[str, Sequence[str]] = {
    "simple": ["id", "task_id", "name", "task_type", "project_id", "app_type", "owner_user_id", "period_type",
               "is_deleted"],
    "full": ["id", "task_id", "name", "task_type", "project_id", "app_type", "owner_user_id", "period_type",
             "is_deleted", "submit_status", "version_id", "flow_id", "schedule_conf", "task_params"],
    "with_sql": ["id", "task_id", "name", "sql_text"],
}


def page(df: DataFrame, order: str | None, number: int | None, size: int | None,
         descending: bool = True, tiebreak: str = "id") -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, which the caller must give; None for all rows.

    The tiebreak makes pages disjoint. Sort plus limit runs as a per-partition
    top-k, so a page costs one pass and no global sort.
    """
    if order is not None:
        first = F.desc(order) if descending else F.asc(order)
        keys = [first] if order == tiebreak else [first, F.asc(tiebreak)]
        df = df.orderBy(*keys)
    if size is None:
        return df
    if number is not None and number > 1:
        df = df.offset((number - 1) * size)
    return df.limit(size)


def keyset(df: DataFrame, last: int, n: int, key: str = "id") -> DataFrame:
    """The next ``n`` rows after key ``last``; constant cost however far the reader is."""
    return df.where(F.col(key) > last).orderBy(key).limit(n)


def flow_rows(jobs: DataFrame, mode: str) -> DataFrame:
    """Workflow rows: ``parents`` (flows and plain instances), ``no_parents`` (members and plain ones), ``all``."""
    if mode == "parents":
        return jobs.where(F.col("flow_job_id") == "0")
    if mode == "no_parents":
        return jobs.where(~F.col("task_type").isin(dims.FLOW_TYPES))
    if mode == "all":
        return jobs
    raise ValueError(f"unknown mode {mode}")


def jobs_of_cycle(jobs: DataFrame, prefix: str, name: str, last: int | None = None, n: int | None = None,
                  schedule_type: int | None = 0) -> DataFrame:
    """Instances whose cycle time and name start with the given texts, in id order, optionally one keyset batch."""
    out = filter_by(jobs, type=schedule_type).where(
        F.col("cyc_time").startswith(prefix) & F.col("job_name").startswith(name))
    return out.orderBy("id") if n is None else keyset(out, last if last is not None else -1, n)


def sort_jobs(df: DataFrame, flags: Iterable[tuple[str, bool]]) -> DataFrame:
    """Sort by the given (column, ascending) flags, id last."""
    keys = [F.asc(c) if up else F.desc(c) for c, up in flags]
    return df.orderBy(*keys, F.asc("id"))


def sort_instances(df: DataFrame) -> DataFrame:
    """By cycle time as a number; times that are no number come last."""
    return df.orderBy(F.asc_nulls_last(F.col("cyc_time").try_cast("long")), F.asc("id"))


def changed_since(jobs: DataFrame, moment: dt.datetime, compute_type: int | None = None) -> DataFrame:
    """Instances modified at or after a moment."""
    return filter_by(jobs, compute_type=compute_type).where(
        F.col("gmt_modified") >= F.lit(moment).cast("timestamp_ntz"))

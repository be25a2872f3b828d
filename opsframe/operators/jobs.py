"""Statistics, charts, roll-ups and listings over the instance table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe import dims
from opsframe.functions.status import bucket_of, show_status
from opsframe.functions.text import duration_text, split_time
from opsframe.operators.filters import (
    filter_by, filter_status, flow_rows, in_biz_window, name_matches, page, search_name,
)
from opsframe.plans.ordered import chunked, numbered


def _count(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


def _ntz(moment: dt.datetime | dt.date) -> Column:
    if not isinstance(moment, dt.datetime):
        moment = dt.datetime.combine(moment, dt.time())
    return F.lit(moment).cast("timestamp_ntz")


# --- state buckets -------------------------------------------------------------------------------

def count_by_status(jobs: DataFrame, cyc_start: str | None = None, cyc_end: str | None = None, **criteria) -> DataFrame:
    """Rows per raw status."""
    out = filter_by(jobs, **criteria)
    if cyc_start is not None:
        out = out.where(F.col("cyc_time") >= cyc_start)
    if cyc_end is not None:
        out = out.where(F.col("cyc_time") < cyc_end)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"))


def status_buckets(jobs: DataFrame, by: str | None = None) -> DataFrame:
    """All eight merged buckets with their count and the total of listed buckets, per group of ``by``.

    One aggregation gives every bucket as its own conditional count; a dense
    result therefore needs neither a second scan nor an outer join.
    """
    groups = [by] if by else []
    counts = [_count(F.col("status").isin(members)).alias(dims.STATUS_NAME[code])
              for code, members in dims.MERGED.items()]
    wide = jobs.groupBy(*groups).agg(*counts)
    names = [dims.STATUS_NAME[c] for c in dims.MERGED]
    wide = wide.withColumn("total", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    return wide.unpivot([*groups, "total"], names, "bucket", "cnt").select(*groups, "bucket", "cnt", "total")


def status_statistics(jobs: DataFrame, by: str | None = None) -> DataFrame:
    """The ten failure-split buckets plus ALL, without the rows of flow parents."""
    groups = [by] if by else []
    rows = flow_rows(jobs, "no_parents")
    counts = [_count(F.col("status").isin(members)).alias(dims.STATUS_NAME[code])
              for code, members in dims.SPLIT.items()]
    wide = rows.groupBy(*groups).agg(*counts)
    names = [dims.STATUS_NAME[c] for c in dims.SPLIT]
    wide = wide.withColumn("ALL", sum((F.col(n) for n in names[1:]), F.col(names[0])))
    return wide.unpivot(groups, [*names, "ALL"], "bucket", "cnt")


# --- queues --------------------------------------------------------------------------------------

def queue_summary(cache: DataFrame) -> DataFrame:
    """Per resource and stage: oldest waiting row as epoch seconds, and size."""
    return cache.where("is_deleted = 0").groupBy("job_resource", "stage").agg(
        F.unix_seconds(F.min("gmt_create").cast("timestamp")).alias("generate_time"),
        F.count(F.lit(1)).alias("job_size")).orderBy("job_resource", "stage")


def queue_overview(cache: DataFrame, now: dt.datetime) -> DataFrame:
    """One row per resource with size and waiting time of each of the five stages; absent stages are 0 and ''."""
    moment = F.unix_millis(_ntz(now).cast("timestamp"))
    sizes, oldest = [], []
    for name, stage in dims.STAGE.items():
        here = F.col("stage") == stage
        sizes.append(_count(here).alias(f"{name.lower()}_size"))
        oldest.append(F.min(F.when(here, F.col("gmt_create"))).alias(f"_{name}"))
    wide = cache.where("is_deleted = 0").groupBy("job_resource").agg(*sizes, *oldest)
    waits = [
        F.when(F.col(f"_{n}").isNull(), F.lit("")).otherwise(
            duration_text(moment - F.unix_seconds(F.col(f"_{n}").cast("timestamp")) * 1000)).alias(f"{n.lower()}_wait")
        for n in dims.STAGE]
    return wide.select("job_resource", *[f"{n.lower()}_size" for n in dims.STAGE], *waits)


def dense_pairs(cache: DataFrame) -> DataFrame:
    """Every (resource, stage) pair with its size, 0 where nothing waits."""
    stages = F.explode(F.array(*[F.lit(s) for s in dims.STAGE.values()])).alias("stage")
    pairs = cache.select("job_resource").distinct().select("job_resource", stages)
    sizes = cache.groupBy("job_resource", F.col("stage").cast("int").alias("stage")).agg(
        F.count(F.lit(1)).alias("job_size"))
    return pairs.join(sizes, ["job_resource", "stage"], "left").fillna(0, ["job_size"])


def min_priority(cache: DataFrame, stages: Sequence[int] = ()) -> DataFrame:
    """Lowest priority per resource."""
    return filter_by(cache, is_deleted=0, stage=list(stages)).groupBy("job_resource").agg(
        F.min("job_priority").alias("min_priority"))


def min_job_id(jobs: DataFrame, start: str, end: str) -> DataFrame:
    """First id of a trigger window."""
    return jobs.where(F.col("cyc_time").between(start, end)).agg(F.min("id").alias("min_id"))


def queue_order(cache: DataFrame, level: str | None = None, number: int | None = None,
                size: int | None = None) -> DataFrame:
    """Queue rows with their priority (``generate_time + level * 100000`` unless one is set), in serving order."""
    lvl = F.coalesce(F.col(level), F.lit(10)) if level else F.lit(10)
    generated = F.unix_millis(F.col("gmt_create").cast("timestamp"))
    priority = F.when(F.col("job_priority") > 0, F.col("job_priority")).otherwise(generated + lvl * 100_000)
    out = cache.withColumn("priority", priority).orderBy(F.desc("stage"), F.asc("priority"), F.asc("job_id"))
    if size is None:
        return out
    return (out.offset((number - 1) * size) if number and number > 1 else out).limit(size)


def stick(cache: DataFrame, chosen: DataFrame) -> DataFrame:
    """Moves the chosen jobs to the front of their queue: lowest priority of the queue minus one, 0 for an empty one."""
    lowest = min_priority(cache)
    marked = cache.join(chosen.select("job_id").distinct().withColumn("_up", F.lit(True)), "job_id", "left")
    front = F.coalesce(F.col("min_priority") - 1, F.lit(0))
    out = marked.join(lowest, "job_resource", "left").withColumn(
        "job_priority", F.when(F.col("_up"), front).otherwise(F.col("job_priority")))
    return out.select(*cache.columns)


# --- counts --------------------------------------------------------------------------------------

def count_tasks(tasks: DataFrame, by: str = "project_id", **criteria) -> DataFrame:
    return filter_by(tasks, **criteria).groupBy(by).agg(F.count(F.lit(1)).alias("cnt"))


def distinct_fills(jobs: DataFrame, by: str | None = None, **criteria) -> DataFrame:
    """Distinct backfills among the instances that match."""
    rows = filter_by(jobs, **criteria).where("fill_id > 0")
    return rows.groupBy(*([by] if by else [])).agg(F.countDistinct("fill_id").alias("fills"))


SCIENCE_DEPLOYED, SCIENCE_FAILED, SCIENCE_DONE = [0, 10, 16], [8, 9], [5]


def science_counts(jobs: DataFrame, by: str | None = None, **criteria) -> DataFrame:
    """Total, deployed, failed and successful in one pass."""
    s = F.col("status")
    return filter_by(jobs, **criteria).groupBy(*([by] if by else [])).agg(
        F.count(F.lit(1)).alias("total"), _count(s.isin(SCIENCE_DEPLOYED)).alias("deployed"),
        _count(s.isin(SCIENCE_FAILED)).alias("failed"), _count(s.isin(SCIENCE_DONE)).alias("success"))


# --- profiles ------------------------------------------------------------------------------------

_CHART_STATES = dims.FINISH + dims.FAILED


def _hours(spark) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("int").alias("hour"))


def hourly_profile(jobs: DataFrame, day: dt.date, days: int | None = None, ts: str = "cyc_ts") -> DataFrame:
    """Finished and failed instances per hour of day, 24 dense slots; over ``days`` days back, divided by ``days``."""
    start = day - dt.timedelta(days=days or 0)
    rows = jobs.where((F.col(ts) >= _ntz(start)) & (F.col(ts) < _ntz(day + dt.timedelta(days=1)))
                      & F.col("status").isin(_CHART_STATES) & (F.col("type") == 0))
    counts = rows.groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("cnt"))
    out = _hours(jobs.sparkSession).join(counts, "hour", "left").select(
        "hour", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))
    return out.withColumn("cnt", F.floor(F.col("cnt") / days).cast("long")) if days else out


def job_chart(jobs: DataFrame, today: dt.date, ts: str = "cyc_ts") -> DataFrame:
    """Today, yesterday and the 30-day average per hour, from one scan of 31 days."""
    one = dt.timedelta(days=1)
    rows = jobs.where((F.col(ts) >= _ntz(today - 30 * one)) & (F.col(ts) < _ntz(today + one))
                      & F.col("status").isin(_CHART_STATES) & (F.col("type") == 0))
    t = F.col(ts)
    counts = rows.groupBy(F.hour(ts).alias("hour")).agg(
        _count(t >= _ntz(today)).alias("today"),
        _count((t >= _ntz(today - one)) & (t < _ntz(today))).alias("yesterday"),
        F.count(F.lit(1)).alias("month"))
    dense = _hours(jobs.sparkSession).join(counts, "hour", "left").fillna(0)
    return dense.withColumn("month", F.floor(F.col("month") / 30).cast("long"))


def daily_chart(jobs: DataFrame, today: dt.date, ts: str = "cyc_ts") -> DataFrame:
    """Thirty dense days up to today: label, total, success, failed and pending."""
    first = today - dt.timedelta(days=29)
    rows = jobs.where((F.col(ts) >= _ntz(first)) & (F.col(ts) < _ntz(today + dt.timedelta(days=1)))
                      & (F.col("type") == 0))
    s = F.col("status")
    counts = rows.groupBy(F.col(ts).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), _count(s.isin(SCIENCE_DONE)).alias("success"),
        _count(s.isin(SCIENCE_FAILED)).alias("failed"), _count(s.isin(SCIENCE_DEPLOYED)).alias("pending"))
    days = jobs.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(today))).alias("day"))
    return days.join(counts, "day", "left").fillna(0).select(
        F.date_format("day", "MM/dd").alias("label"), "total", "success", "failed", "pending")


# --- backfills -----------------------------------------------------------------------------------

def fill_progress(jobs: DataFrame, fills: DataFrame) -> DataFrame:
    """Per backfill: finished, all bucketed instances, and done (failed, canceled, frozen or finished)."""
    bucket = bucket_of(F.col("status"))
    counts = jobs.where("fill_id > 0").groupBy(F.col("fill_id").alias("id")).agg(
        _count(bucket == 5).alias("finished"), _count(bucket.isNotNull()).alias("total"),
        _count(bucket.isin(8, 7, 18, 5)).alias("done"))
    return fills.join(counts, "id", "left").fillna(0, ["finished", "total", "done"])


def fill_preview(fills: DataFrame, jobs: DataFrame, number: int | None = None, size: int | None = None,
                 order: str = "id", **criteria) -> DataFrame:
    """Backfills that have matching instances, newest first, each with its progress and the distinct total."""
    matching = filter_by(jobs, **criteria).where("fill_id > 0").select(F.col("fill_id").alias("id")).distinct()
    chosen = fills.join(matching, "id", "left_semi")
    total = chosen.agg(F.count(F.lit(1)).alias("fill_total"))
    rows = page(fill_progress(jobs, chosen), order, number, size)
    # the total is one row by construction
    return rows.crossJoin(F.broadcast(total))


def fill_records(jobs: DataFrame, tasks: DataFrame, fill: int | Sequence[int] | None = None, **criteria) -> DataFrame:
    """Instances of a backfill with show status, display day, duration and their flow."""
    rows = search_jobs(jobs, tasks, number=None, size=None, schedule_type=1, paged=False, members=True, **criteria)
    rows = filter_by(rows, fill_id=fill)
    cyc = F.col("cyc_time")
    return rows.select(
        "id", "job_id", "fill_id", "task_id", show_status(F.col("status"), True).alias("show_status"),
        F.concat_ws("-", cyc.substr(1, 4), cyc.substr(5, 2), cyc.substr(7, 2)).alias("day"),
        duration_text(F.col("exec_time") * 1000).alias("run_time"), "flow_job_id")


# --- workflows -----------------------------------------------------------------------------------

def workflow_status(jobs: DataFrame) -> DataFrame:
    """One status per workflow instance from its members; without members it is FINISHED.

    All rules are conditional aggregates, so a flow with very many members is
    reduced before the shuffle. The canceled kind follows the last member by id.
    """
    s = F.col("status")
    canceled = s.isin(dims.STOP + [18])
    members = jobs.where(F.col("flow_job_id") != "0").groupBy("flow_job_id").agg(
        F.bool_or(~s.isin(dims.STOPPED)).alias("_open"), F.bool_and(s == 18).alias("_frozen"),
        F.bool_or(s.isin(dims.RUN_FAILED)).alias("_failed"), F.bool_or(s == 9).alias("_submit"),
        F.bool_or(s == 21).alias("_parent"),
        F.max_by(F.when(canceled, s), F.when(canceled, F.col("id"))).alias("_last"))
    flows = jobs.where(F.col("task_type").isin(dims.FLOW_TYPES)).select("job_id")
    joined = flows.join(members.withColumnRenamed("flow_job_id", "job_id"), "job_id", "left")
    status = (
        F.when(F.col("_open").isNull(), 5).when(F.col("_open"), 4).when(F.col("_frozen"), 18)
        .when(F.col("_failed"), 8).when(F.col("_submit"), 9).when(F.col("_parent"), 21)
        .when(F.col("_last") == 26, 26).when(F.col("_last").isNotNull(), 7).otherwise(5)
    )
    return joined.select("job_id", status.cast("int").alias("flow_status"))


def propagate_flow_status(jobs: DataFrame) -> DataFrame:
    """Members take over EXPIRE or FROZEN of their flow.

    Plain instances all share the flow id '0'; they skip the join, which would
    otherwise send them to one task.
    """
    pushed = jobs.where(F.col("task_type").isin(dims.FLOW_TYPES) & F.col("status").isin(24, 18)).select(
        F.col("job_id").alias("flow_job_id"), F.col("status").alias("_pushed"))
    members = jobs.where(F.col("flow_job_id") != "0").join(pushed, "flow_job_id", "left")
    changed = members.withColumn("status", F.coalesce("_pushed", "status")).select(*jobs.columns)
    return changed.unionByName(jobs.where(F.col("flow_job_id") == "0"))


def nest_workflows(page_rows: DataFrame, jobs: DataFrame, size: int = 1000, limit: int | None = None) -> DataFrame:
    """Flows with their members as ordered lists of ids; flows missing from the page are fetched, orphans stay rows.

    A list holds at most ``size`` members; a larger flow has several rows, numbered by ``chunk``.
    """
    members = page_rows.where(F.col("flow_job_id") != "0")
    heads = page_rows.where(F.col("flow_job_id") == "0").select("job_id", "id")
    wanted = members.select(F.col("flow_job_id").alias("job_id")).distinct()
    flows = jobs.join(wanted, "job_id", "left_semi").select("job_id", "id")
    known = members.join(flows.select(F.col("job_id").alias("flow_job_id")), "flow_job_id", "left_semi")
    orphans = members.join(flows.select(F.col("job_id").alias("flow_job_id")), "flow_job_id", "left_anti")
    lists = chunked(known.select(F.col("flow_job_id").alias("job_id"), F.col("id").alias("member")),
                    ["job_id"], ["member"], F.col("member"), size, "related", limit)
    top = heads.unionByName(flows).unionByName(orphans.select("job_id", "id")).distinct()
    return top.join(lists, "job_id", "left").withColumn("chunk", F.coalesce("chunk", F.lit(0)).cast("long"))


def tasks_by_app(jobs: DataFrame, size: int = 100_000, limit: int | None = None) -> DataFrame:
    """Sorted task ids per app, in lists of at most ``size``."""
    return chunked(jobs.select("app_type", "task_id").distinct(), ["app_type"], ["task_id"], F.col("task_id"),
                   size, "task_ids", limit)


def group_frequent(jobs: DataFrame, size: int = 1440, limit: int | None = None) -> DataFrame:
    """Minute and hour instances folded into one row per task and day (lists of at most ``size`` ids); others as they are."""
    rows = jobs.select("task_id", F.col("cyc_ts").cast("date").alias("day"), "id", "period_type")
    often = rows.where(F.col("period_type").isin(0, 1))
    folded = chunked(often, ["task_id", "day"], ["id"], F.col("id"), size, "ids", limit)
    rest = rows.where(~F.col("period_type").isin(0, 1)).select(
        "task_id", "day", F.lit(0).cast("long").alias("chunk"), F.array("id").alias("ids"))
    return folded.select("task_id", "day", "chunk", "ids", F.lit(True).alias("grouped")).unionByName(
        rest.withColumn("grouped", F.lit(False)))


def expand_frequent(groups: DataFrame) -> DataFrame:
    """Back from folded rows to one row per instance."""
    return groups.select("task_id", "day", F.explode("ids").alias("id"))


# --- logs ----------------------------------------------------------------------------------------

def job_logs(logs: DataFrame, job_id: object | None = None, lines: int = 10_000,
             limit: int | None = None) -> DataFrame:
    """Log text per job and component in time order, between banner lines, at most ``lines`` messages per chunk.

    Rows ordered by (component, chunk) give the whole log of a job.
    """
    rows = filter_by(logs, job_id=job_id)
    parts = chunked(rows, ["job_id", "component"], ["seq"], F.col("message"), lines, "_lines", limit)
    # one row per chunk, so the window is at least ``lines`` times smaller than the log
    after = F.lead("chunk").over(Window.partitionBy("job_id", "component").orderBy("chunk"))
    head = F.when(F.col("chunk") == 0, F.concat(F.lit("#" * 15), "component", F.lit("#" * 15 + "\n"))).otherwise("")
    tail = F.when(after.isNull(), F.lit("#" * 51 + "\n")).otherwise("")
    body = F.concat(F.array_join("_lines", "\n"), F.lit("\n"))
    return parts.select("job_id", "component", "chunk", F.concat(head, body, tail).alias("text"))


# --- top lists and recent runs -------------------------------------------------------------------

def top_run_time(jobs: DataFrame, lo: dt.datetime, hi: dt.datetime, n: int = 10) -> DataFrame:
    """The longest runs started in [lo, hi), with their duration as text."""
    rows = jobs.where((F.col("exec_start_time") >= _ntz(lo)) & (F.col("exec_start_time") < _ntz(hi)))
    return rows.orderBy(F.desc("exec_time"), F.asc("id")).limit(n).select(
        "id", "task_id", split_time(F.col("cyc_time")).alias("cyc_time"), "type", "task_type", "exec_time",
        duration_text(F.col("exec_time") * 1000).alias("run_time"))


def top_errors(jobs: DataFrame, today: dt.date, days: int = 30, n: int = 10) -> DataFrame:
    """Tasks with most failed normal instances since ``days`` days ago."""
    start = (today - dt.timedelta(days=days)).strftime("%Y%m%d") + "000000"
    rows = jobs.where((F.col("cyc_time") >= start) & F.col("status").isin(dims.FAILED) & (F.col("type") == 0))
    return rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("errors")).orderBy(
        F.desc("errors"), F.asc("task_id")).limit(n)


def latest_per(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Whole newest row per key by aggregation; nothing but one row per key and partition is shuffled."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_checkpoint(df: DataFrame, by: str = "task_id", order: str = "checkpoint_id") -> DataFrame:
    """Newest live checkpoint with a save path per task or per run."""
    live = df.where((F.col("is_deleted") == 0) & F.col("checkpoint_savepath").isNotNull())
    return latest_per(live, [by], [order, "id"])


def expire_checkpoints(df: DataFrame, n: int, by: str = "task_engine_id") -> DataFrame:
    """Flags checkpoints below the n-th newest one with a save path of their run."""
    newest = Window.partitionBy(by).orderBy(F.desc("checkpoint_id"))
    # rank <= n is pushed below the shuffle as a per-partition group limit
    kept = df.where((F.col("is_deleted") == 0) & F.col("checkpoint_savepath").isNotNull()).select(
        by, "checkpoint_id", F.row_number().over(newest).alias("_rn")).where(F.col("_rn") <= n)
    threshold = kept.where(F.col("_rn") == n).select(by, F.col("checkpoint_id").alias("_from"))
    gone = F.col("checkpoint_id") < F.col("_from")
    return df.join(threshold, by, "left").withColumn(
        "is_deleted", F.when(gone, 1).otherwise(F.col("is_deleted")).cast("int")).drop("_from")


def recent_per(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest n rows per key; the rank limit runs before the shuffle."""
    newest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def recent_runs(jobs: DataFrame, task_id: int | None = None, n: int = 20) -> DataFrame:
    """Newest n successful runs per task by business date; runs without a duration are dropped after the limit."""
    rows = filter_by(jobs, task_id=task_id).where(F.col("status").isin(dims.FINISH))
    return recent_per(rows, ["task_id"], ["business_date", "id"], n).where(
        F.col("exec_time").isNotNull() & (F.col("exec_time") != 0)).select(
        "task_id", "id", "exec_time", "exec_start_time", "exec_end_time")


def recent_stats(jobs: DataFrame, n: int) -> DataFrame:
    return recent_per(jobs, ["task_id"], ["cyc_ts", "id"], n).select("task_id", "id", "status", "exec_time")


def last_retries(retries: DataFrame, n: int = 5, by: str = "job_id", order: str = "id") -> DataFrame:
    return recent_per(retries, [by], [order], n)


def neighbour_periods(jobs: DataFrame, after: bool, size: int, of: DataFrame | None = None,
                      limit: int | None = None) -> DataFrame:
    """Other periods of the same task before or after an instance, newest first, ``size`` per instance.

    ``of`` names the instances (all when None). Rows get their position in the
    task once; an instance then meets exactly ``size`` positions by an equi-join.
    """
    keys, order = ["task_id", "app_type", "type"], ["cyc_ts", "id"]
    rows = numbered(jobs.select(*keys, "id", "cyc_ts", "cyc_time", "status", "version_id"), keys, order, "_pos",
                    limit=limit)
    chosen = rows if of is None else rows.join(of.select("id"), "id", "left_semi")
    # instances of one moment have one place: positions count from the first or last row of that moment
    tied = rows.groupBy(*keys, "cyc_ts").agg(F.min("_pos").alias("_lo"), F.max("_pos").alias("_hi"))
    chosen = chosen.join(tied, [*keys, "cyc_ts"])
    if after:
        total = rows.groupBy(*keys).agg(F.max("_pos").alias("_n"))
        chosen = chosen.join(total, keys)
        first, last = F.greatest(F.col("_hi") + 1, F.col("_n") - size + 1), F.col("_n")
    else:
        first, last = F.greatest(F.col("_lo") - size, F.lit(1)), F.col("_lo") - 1
    wanted = chosen.where(first <= last).select(
        *keys, F.col("id").alias("of_id"), F.explode(F.sequence(first, last)).alias("_pos"))
    return wanted.join(rows, [*keys, "_pos"]).select(
        "of_id", "id", split_time(F.col("cyc_time")).alias("cyc_time"), "status", "task_id", "version_id")


def first_child(edges: DataFrame) -> DataFrame:
    """One child edge per parent and child task: the earliest by (time, key). Needs task_id and cyc_time of the child."""
    return edges.groupBy("parent_job_key", "task_id").agg(
        F.min_by("job_key", F.struct("cyc_time", "job_key")).alias("job_key"))


# --- listings ------------------------------------------------------------------------------------

def search_jobs(jobs: DataFrame, tasks: DataFrame, name: str | None = None, mode: str | None = "fuzzy",
                owner: int | None = None, groups: Iterable[int] = (), split: bool = True,
                cyc_start: dt.date | None = None, cyc_end: dt.date | None = None, biz_start: dt.date | None = None, biz_end: dt.date | None = None, schedule_type: int | None = 0,
                number: int | None = 1, size: int | None = 20, paged: bool = True, members: bool = False, **criteria) -> DataFrame:
    """Instance listing. Members of flows appear with ``members`` or once a name, states, task types or cycle days are asked for; else only
    flow parents and plain instances."""
    groups = list(groups)
    out = filter_by(jobs, type=schedule_type, is_deleted=0, **criteria)
    out = filter_status(in_biz_window(out, biz_start, biz_end), groups, split)
    if cyc_start:
        out = out.where(F.col("cyc_ts") >= F.lit(cyc_start).cast("timestamp_ntz"))
    if cyc_end:
        out = out.where(F.col("cyc_ts") < F.lit(cyc_end + dt.timedelta(days=1)).cast("timestamp_ntz"))
    if name or owner is not None:
        chosen = filter_by(search_name(tasks, "name", name, mode), owner_user_id=owner).select("task_id")
        out = out.join(chosen, "task_id", "left_semi")
    if not (members or name or groups or cyc_start or cyc_end or criteria.get("task_type") is not None):
        out = flow_rows(out, "parents")
    return page(out, "gmt_modified", number, size) if paged else out


def count_found(found: DataFrame) -> DataFrame:
    """One row ``total``: how many rows a listing has over all its pages; takes it unpaged."""
    return found.agg(F.count(F.lit(1)).alias("total"))


def search_tasks(tasks: DataFrame, name: str | None = None, mode: str | None = "fuzzy", number: int | None = 1,
                 size: int | None = 20, order: str = "id", **criteria) -> DataFrame:
    """Task listing with the number of submitted live tasks beside each row of the page."""
    rows = filter_by(tasks, is_deleted=0, **criteria)
    if name:
        rows = rows.where(name_matches(F.col("name"), name, mode))
    published = filter_by(tasks, submit_status=1, is_deleted=0).agg(F.count(F.lit(1)).alias("published"))
    # one row by construction
    return page(rows, order, number, size).crossJoin(F.broadcast(published))

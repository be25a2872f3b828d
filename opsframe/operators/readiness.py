"""Readiness of pending instances: own state, expiry, parents, and the previous period of children."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe import dims
from opsframe.operators.calendar import CRON_PREFIX, parse_rules, trigger_before
from opsframe.functions.keys import job_key
from opsframe.functions.params import STAMP
from opsframe.plans.ordered import carried, find_hot
from opsframe.plans.storage import materialise

R = dims.READINESS
PAUSED_TASK, PAUSED_PROJECT = 2, 1


def _column(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def expired(now: dt.datetime) -> Column:
    """Expiry of a joined instance and rule: minute and hour, normal, not restarted, outside flows, past the next cycle."""
    moment = F.lit(now).cast("timestamp_ntz")
    following = F.try_to_timestamp("next_cyc_time", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    last_of_day = F.dayofmonth(following) != F.dayofmonth("cyc_ts")
    late = following < moment
    mode = F.col("rule.is_last_instance")
    by_mode = (
        F.when(mode.isNull(), late)
        .when(mode, ~last_of_day & late)
        .otherwise(F.when(last_of_day, F.dayofmonth(following) == now.day).otherwise(late))
    )
    applies = ((F.col("type") == 0) & F.col("rule.period").isin(0, 1) & (F.col("is_restart") == 0)
               & (F.col("flow_job_id") == "0") & (F.col("rule.is_expire") == 1))
    return F.coalesce(applies & by_mode, F.lit(False))


def with_rules(jobs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Instances with their task's rule and state; instances without a live task have a null ``_alive``."""
    live = parse_rules(tasks.where("is_deleted = 0"))
    facts = live.select(
        "task_id", "rule", F.lit(True).alias("_alive"),
        _column(tasks, "schedule_status", F.lit(1)).alias("_task_state"),
        _column(tasks, "project_schedule_status", F.lit(0)).alias("_project_state"))
    return jobs.join(facts, "task_id", "left")


def own_checks(jobs: DataFrame, tasks: DataFrame, now: dt.datetime, limited: DataFrame | None = None) -> DataFrame:
    """Instances with ``own``: the outcome of their own state, null when only the edges decide."""
    rows = with_rules(jobs, tasks)
    if limited is None:
        rows = rows.withColumn("_over", F.lit(False))
    else:
        marks = limited.select("task_id", F.lit(True).alias("_mark")).distinct()
        rows = rows.join(marks, "task_id", "left").withColumn("_over", F.coalesce("_mark", F.lit(False))).drop("_mark")
    today = now.strftime("%Y%m%d") + "000000"
    busy_states = dims.RUNNING + dims.WAIT + [10]
    # self-dependent tasks wait for their own running instance before anything of theirs expires
    busy = jobs.where((F.col("type") == 0) & F.col("status").isin(busy_states) & (F.col("cyc_time") >= today)).select(
        "task_id", F.lit(True).alias("_busy")).distinct()
    rows = rows.join(busy, "task_id", "left")
    waits = F.col("dependency_type").isin(1, 3) & F.coalesce("_busy", F.lit(False))
    paused = (F.col("type") == 0) & ((F.col("_task_state") == PAUSED_TASK) | (F.col("_project_state") == PAUSED_PROJECT))
    own = (
        F.when(F.col("_alive").isNull(), R["TASK_DELETE"])
        .when((F.col("compute_type") == 1) & F.col("_over"), R["RESOURCE_OVER_LIMIT"])
        .when(F.col("status") != 0, R["NOT_UNSUBMIT"])
        .when(paused, R["TASK_PAUSE"])
        .when(F.col("cyc_time") > now.strftime("%Y%m%d%H%M%S"), R["TIME_NOT_REACH"])
        .when(expired(now), F.when(waits, R["TIME_NOT_REACH"]).otherwise(R["TIME_OVER_EXPIRE"]))
    )
    return rows.select(*jobs.columns, own.cast("int").alias("own"))


def edge_outcomes(pending: DataFrame, edges: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_key, outcome) per edge of the pending instances.

    Parents are looked up once by key. The lookup side is unique, so adaptive
    execution can split a parent that a third of all edges point to.
    """
    parents = jobs.select(
        F.col("job_key").alias("parent_job_key"), F.col("type").alias("type"), F.col("task_id").alias("_ptask"),
        F.col("status").alias("_pstatus"), F.col("task_type").alias("_ptype"))
    mine = pending.select("job_key", "task_id", "type", "dependency_type", "flow_job_id")
    rows = mine.join(edges.select("job_key", "parent_job_key"), "job_key", "inner").join(
        parents, ["parent_job_key", "type"], "left")
    s = F.col("_pstatus")
    own = F.col("_ptask") == F.col("task_id")
    entry = (F.col("flow_job_id") != "0") & F.col("_ptype").isin(dims.FLOW_TYPES) & (s == dims.STATUS["RUNNING"])
    outcome = (
        F.when(s.isNull(), F.when(F.col("type") == 1, R["CAN_EXE"]).otherwise(R["FATHER_NO_CREATED"]))
        .when(entry, R["CAN_EXE"])
        .when(own & F.col("dependency_type").isin(3, 4),
              F.when(s.isin(dims.STOPPED), R["CAN_EXE"]).otherwise(R["FATHER_JOB_NOT_FINISHED"]))
        .when(s.isin(8, 9, 21),
              F.when(own, R["SELF_PRE_PERIOD_EXCEPTION"]).otherwise(R["FATHER_JOB_EXCEPTION"]))
        .when(s == 18, F.when(own, R["CAN_EXE"]).otherwise(R["DEPENDENCY_JOB_FROZEN"]))
        .when(s.isin(7, 13, 26), R["DEPENDENCY_JOB_CANCELED"])
        .when(s == 24, R["DEPENDENCY_JOB_EXPIRE"])
        .when(~s.isin(dims.FINISH), R["FATHER_JOB_NOT_FINISHED"])
        .otherwise(R["CAN_EXE"])
    )
    return rows.select("job_key", outcome.cast("int").alias("outcome"))


def worst(col: Column) -> Column:
    """Combines edge outcomes: a definite block (lowest code) beats unfinished, which beats runnable."""
    rank = F.when(col == R["CAN_EXE"], 102).when(col == R["FATHER_JOB_NOT_FINISHED"], 101).otherwise(col)
    low = F.min(rank)
    return F.when(low == 102, R["CAN_EXE"]).when(low == 101, R["FATHER_JOB_NOT_FINISHED"]).otherwise(low)


def child_period_check(pending: DataFrame, jobs: DataFrame, edges: DataFrame, tasks: DataFrame,
                       limit: int | None = None) -> DataFrame:
    """(job_key, outcome) for modes 2 and 4: the previous period of direct children must be done.

    Without children, the nearest earlier period of the task that has children
    decides, by the state of those children.
    """
    mine = pending.where(F.col("dependency_type").isin(2, 4)).select(
        "job_key", "task_id", "type", "dependency_type", "cyc_ts", "id")
    facts = jobs.select("job_key", F.col("task_id").alias("_ctask"), F.col("cyc_ts").alias("_cts"),
                        F.col("cyc_time").alias("_ctime"), F.col("status").alias("_cstatus"), "type")
    links = edges.select("job_key", "parent_job_key")
    # direct children: the earliest instance per child task, then its previous period by rule; only children of
    # the pending instances look up their facts
    direct = mine.select(F.col("job_key").alias("parent_job_key")).join(links, "parent_job_key", "inner").join(
        facts.drop("type"), "job_key", "inner")
    earliest = direct.groupBy("parent_job_key", "_ctask").agg(
        F.min_by("_cts", F.struct("_ctime", "job_key")).alias("_cts"))
    rules = parse_rules(tasks.where("is_deleted = 0")).where(F.col("rule_error").isNull()).select(
        F.col("task_id").alias("_ctask"), F.col("id").alias("_shade"), "rule")
    before = earliest.join(rules, "_ctask", "inner").withColumn(
        "_prev", trigger_before("rule", "_cts")).select(
        "parent_job_key",
        job_key(F.lit(CRON_PREFIX), F.col("_shade"), F.date_format("_prev", STAMP)).alias("job_key"))
    seen = before.join(facts.select("job_key", "_cstatus"), "job_key", "inner")
    # no such period: the nearest earlier period of the task with children
    empty = mine.join(seen.select(F.col("parent_job_key").alias("job_key")).distinct(), "job_key", "left_anti")
    has = links.select(F.col("parent_job_key").alias("job_key")).distinct().withColumn("_has", F.lit(True))
    of_tasks = jobs.join(empty.select("task_id").distinct(), "task_id", "left_semi").select(
        "job_key", "task_id", "type", "cyc_ts", "id").join(has, "job_key", "left")
    # counted on the bare instance table: a superset of these rows that costs one narrow scan
    hot = find_hot(jobs.select("task_id", "type"), ["task_id", "type"], limit)
    walked = carried(of_tasks, ["task_id", "type"], ["cyc_ts", "id"],
                     F.when(F.col("_has"), F.col("job_key")), "_earlier", current=False, hot=hot)
    back = walked.where(F.col("_earlier").isNotNull()).join(empty.select("job_key"), "job_key", "left_semi").select(
        F.col("job_key").alias("_for"), F.col("_earlier").alias("parent_job_key"))
    found = back.join(links, "parent_job_key", "inner").join(facts.select("job_key", "_cstatus"), "job_key", "inner").select(
        F.col("_for").alias("parent_job_key"), "job_key", "_cstatus")
    every = seen.select("parent_job_key", "job_key", "_cstatus").unionByName(found).where(
        F.col("parent_job_key") != F.col("job_key"))
    checked = every.join(
        mine.select(F.col("job_key").alias("parent_job_key"), "dependency_type"), "parent_job_key", "inner")
    s = F.col("_cstatus")
    ended = s.isin(dims.STOPPED)
    outcome = F.when(
        F.col("dependency_type") == 2,
        F.when(s.isin(dims.FINISH), R["CAN_EXE"]).when(ended, R["CHILD_PRE_NOT_SUCCESS"])
        .otherwise(R["CHILD_PRE_NOT_FINISHED"])).otherwise(
        F.when(ended, R["CAN_EXE"]).otherwise(R["CHILD_PRE_NOT_FINISHED"]))
    return checked.groupBy(F.col("parent_job_key").alias("job_key")).agg(worst(outcome).cast("int").alias("outcome"))


def readiness(jobs: DataFrame, edges: DataFrame, tasks: DataFrame, now: dt.datetime,
              limited: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(job_key, outcome) for every instance, codes as in ``dims.READINESS``."""
    # checked once, in the few columns that the edges need, and read three times
    own, _ = materialise(own_checks(jobs, tasks, now, limited).select(
        "job_key", "task_id", "type", "dependency_type", "flow_job_id", "cyc_ts", "id", "own"), "own")
    open_ = own.where(F.col("own").isNull())
    by_edge = edge_outcomes(open_, edges, jobs).groupBy("job_key").agg(worst(F.col("outcome")).alias("_edge"))
    children = child_period_check(open_, jobs, edges, tasks, limit).withColumnRenamed("outcome", "_child")
    joined = own.select("job_key", "own").join(by_edge, "job_key", "left").join(children, "job_key", "left")
    blocked = F.when(F.col("_edge") != R["CAN_EXE"], F.col("_edge"))
    return joined.select(
        "job_key", F.coalesce("own", blocked, "_child", F.lit(R["CAN_EXE"])).cast("int").alias("outcome"))

"""Calendar rules, plans of a day, previous triggers and parent alignment.

A rule is a handful of numbers, so the trigger at or before any moment has a
closed form. Alignment therefore joins each edge with the *rule row* of its
parent (one row per task) and computes the parent's trigger as an expression:
no trigger table is expanded, nothing is range-joined and no window is needed.
Adaptive execution may split a hub parent, because the rule side is unique.

Rules, links and plans grow with the task table, and their rows are many times larger
than its compressed file, from which a join's strategy is guessed. So these joins are
sort-merge joins by hint: they never pass a table through the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe import dims
from opsframe.functions.keys import BACKFILL_PREFIX, job_key, job_name
from opsframe.functions.params import STAMP
from opsframe.plans.ordered import neighbour

CRON_PREFIX, CRON_NAME = "cronTrigger", "cronJob"

_RULE_DDL = ("periodType STRING, beginHour INT, endHour INT, beginMin INT, endMin INT, gapMin INT, gapHour INT, "
             "hour INT, min INT, weekDay STRING, day STRING, beginDate STRING, endDate STRING, selfReliance STRING, "
             "maxRetryNum STRING, isLastInstance STRING, isExpire STRING")

# The rule as a struct. A minute rule steps by gapMin, an hour rule by gapHour; other rules have one slot a day.
_RULE = """
named_struct(
  'period', p, 'first', CASE WHEN p < 2 THEN d.beginHour * 60 + d.beginMin ELSE d.hour * 60 + d.min END,
  'gap', CASE p WHEN 0 THEN d.gapMin WHEN 1 THEN d.gapHour * 60 ELSE 1 END,
  'slots', CASE WHEN p = 0 AND d.gapMin > 0
                THEN CAST(floor((d.endHour * 60 + d.endMin - d.beginHour * 60 - d.beginMin) / d.gapMin) AS INT)
                WHEN p = 1 AND d.gapHour > 0 THEN CAST(floor((d.endHour - d.beginHour) / d.gapHour) AS INT)
                WHEN p > 1 THEN 0 END,
  'days', CASE WHEN p IN (3, 4) THEN array_sort(transform(split(if(p = 3, d.weekDay, d.day), ','),
                                                          x -> try_cast(trim(x) AS INT))) END,
  'begin_date', try_to_date(d.beginDate), 'end_date', try_to_date(d.endDate),
  'self_reliance', CASE d.selfReliance WHEN 'true' THEN 1 WHEN 'false' THEN 0
                   ELSE coalesce(try_cast(d.selfReliance AS INT), 0) END,
  'max_retry', coalesce(try_cast(d.maxRetryNum AS INT), 0),
  'is_last_instance', try_cast(d.isLastInstance AS BOOLEAN), 'is_expire', try_cast(d.isExpire AS INT))
"""
_RULE_ERROR = """
CASE WHEN d IS NULL THEN 'not a JSON object' WHEN d.periodType IS NULL THEN 'periodType is missing'
     WHEN p IS NULL OR NOT p BETWEEN 0 AND 4 THEN 'period type is not supported'
     WHEN d.beginDate IS NULL THEN 'beginDate is missing' WHEN d.endDate IS NULL THEN 'endDate is missing'
     WHEN p < 2 AND (d.beginHour IS NULL OR d.beginMin IS NULL OR d.endHour IS NULL
                     OR coalesce(if(p = 0, d.gapMin, d.gapHour), 0) < 1 OR (p = 0 AND d.endMin IS NULL))
     THEN 'range is incomplete'
     WHEN p > 1 AND (d.hour IS NULL OR d.min IS NULL) THEN 'time of day is missing'
     WHEN p = 3 AND d.weekDay IS NULL THEN 'weekDay is missing' WHEN p = 4 AND d.day IS NULL THEN 'day is missing' END
"""


def parse_rules(tasks: DataFrame, conf: str = "schedule_conf") -> DataFrame:
    """Adds ``rule`` (struct) and ``rule_error`` (null for a usable rule)."""
    # exploding a one-element array keeps later filters from copying the JSON parser into themselves
    once = tasks.select("*", F.explode(F.array(F.from_json(F.col(conf), _RULE_DDL))).alias("d"))
    doc = once.withColumn("p", F.expr("try_cast(d.periodType AS INT)"))
    checked = doc.withColumn("rule_error", F.expr(_RULE_ERROR)).withColumn("rule", F.expr(_RULE))
    return checked.select(*tasks.columns, "rule", "rule_error")


def _at(day: Column, minute: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=minute.cast("int"))


def minutes_sql(rule: str, day: str) -> str:
    """SQL of the sorted minutes of day at which the rule fires on ``day``."""
    return f"""
CASE WHEN {rule}.slots < 0 OR ({rule}.period = 3 AND NOT array_contains({rule}.days, weekday({day}) + 1))
       OR ({rule}.period = 4 AND NOT array_contains({rule}.days, dayofmonth({day}))) THEN CAST(array() AS ARRAY<INT>)
     ELSE transform(sequence(0, {rule}.slots), i -> {rule}.first + i * {rule}.gap) END"""


def minutes_of_day(rule: str, day: str) -> Column:
    """Sorted minutes of day at which the rule fires on ``day`` (both are column names)."""
    return F.expr(minutes_sql(rule, day))


def triggers_sql(conf: str, day: str) -> str:
    """SQL of the trigger times (trigger_time) of one rule text on one day, from the same texts as ``parse_rules`` and ``expand``."""
    # as in parse_rules the parser stands alone; the condition stands inside the list, so that it stays in the function
    return f"""
SELECT CAST(t.day AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, m, 0) AS trigger_time FROM (
  SELECT r.day, explode(CASE WHEN r.rule_error IS NULL AND r.rule.begin_date <= r.day AND r.day <= r.rule.end_date
    THEN {minutes_sql('r.rule', 'r.day')} ELSE CAST(array() AS ARRAY<INT>) END) AS m FROM (
    SELECT CAST({day} AS DATE) AS day, {_RULE_ERROR} AS rule_error, {_RULE} AS rule FROM (
      SELECT d, try_cast(d.periodType AS INT) AS p FROM (SELECT explode(array(from_json({conf}, '{_RULE_DDL}'))) AS d))) r) t"""


def last_trigger(rule: str, moment: str) -> Column:
    """The rule's last trigger at or before ``moment`` (column name or SQL text).

    Closed form: a slot number for minute, hour and day rules; for week and month
    rules the largest listed day that is not later, in this or an earlier period.
    No two months in a row lack the same day, so two steps back are enough.
    """
    r, day = rule, f"CAST({moment} AS DATE)"
    minute = f"(hour({moment}) * 60 + minute({moment}))"
    late = f"if({minute} >= {r}.first, 0, 1)"

    def at(d: str, m: str) -> str:
        return f"CAST({d} AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, {m}, 0)"

    def listed(limit: str) -> str:
        return f"array_max(filter({r}.days, x -> x <= {limit}))"

    def in_month(back: int) -> str:
        end = f"last_day(add_months({day}, -{back}))"
        limit = f"dayofmonth({day}) - {late}" if back == 0 else f"dayofmonth({end})"
        return f"date_add(trunc({end}, 'MM'), {listed(limit)} - 1)"

    weekday = f"(weekday({day}) + 1)"
    week = (f"date_add({day}, coalesce({listed(f'{weekday} - {late}')}, array_max({r}.days) - 7) - {weekday})")
    month = f"coalesce({in_month(0)}, {in_month(1)}, {in_month(2)})"
    slot = f"least(({minute} - {r}.first) DIV {r}.gap, {r}.slots)"
    daily = at(f"date_sub({day}, {late})",
               f"CAST({r}.first + {r}.gap * if({late} = 0, {slot}, {r}.slots) AS INT)")
    return F.expr(f"CASE WHEN {r}.slots < 0 THEN NULL WHEN {r}.period < 3 THEN {daily} "
                  f"WHEN {r}.period = 3 THEN {at(week, f'{r}.first')} ELSE {at(month, f'{r}.first')} END")


def trigger_before(rule: str, moment: str) -> Column:
    """The rule's last trigger strictly before ``moment``."""
    return last_trigger(rule, f"({moment} - INTERVAL '0.001' SECOND)")


def expand(tasks: DataFrame, first: dt.date, last: dt.date, normal: bool = True) -> DataFrame:
    """All triggers of parsed tasks in a range of days: ``trigger`` and the following one (minute and hour rules).

    A task row becomes up to 1440 rows per day. So the task rows, and not their
    triggers, are shuffled once to spread them over all cores; the rest is narrow.
    """
    r = F.col("rule")
    cores = tasks.sparkSession.sparkContext.defaultParallelism
    rows = tasks.where(F.col("rule_error").isNull()).repartition(cores, "task_id").withColumn(
        "_day", F.explode(F.sequence(F.lit(first), F.lit(last))))
    if normal:
        # a rule is off when it begins after, or ended before, the midnight of the day
        rows = rows.where((r["begin_date"] <= F.col("_day")) & (F.col("_day") <= r["end_date"]))
    rows = rows.withColumn("_slots", minutes_of_day("rule", "_day"))
    rows = rows.select("*", F.posexplode("_slots").alias("_pos", "_minute"))
    following = F.when(F.col("_pos") + 1 < F.size("_slots"),
                       _at(F.col("_day"), F.try_element_at("_slots", F.col("_pos") + 2))).otherwise(
        _at(F.date_add("_day", 1), F.try_element_at("_slots", F.lit(1))))
    return rows.select(
        *tasks.columns, _at(F.col("_day"), F.col("_minute")).alias("trigger"), F.col("_day").alias("trigger_day"),
        (F.col("_pos") == 0).alias("is_first"),
        F.when(r["period"] < 2, following).alias("next_trigger"))


def _instances(triggers: DataFrame, prefix: Column, name: Column, fill_name: Column | None, kind: int) -> DataFrame:
    cyc = F.date_format("trigger", STAMP)
    key = job_key(prefix, F.col("id"), cyc)
    return triggers.select(
        F.md5(key).alias("job_id"), key.alias("job_key"), job_name(name, cyc, fill_name).alias("job_name"), "task_id",
        F.col("trigger").alias("cyc_ts"), cyc.alias("cyc_time"),
        F.date_format(F.col("trigger") - F.make_dt_interval(days=F.lit(1)), STAMP).alias("business_date"),
        F.date_format("next_trigger", "yyyy-MM-dd HH:mm:ss").alias("next_cyc_time"),
        F.lit(dims.STATUS["UNSUBMIT"]).alias("status"), F.lit(kind).alias("type"),
        F.col("rule.period").alias("period_type"), F.col("rule.self_reliance").alias("dependency_type"),
        F.col("rule.max_retry").alias("max_retry_num"), "version_id", "task_type", "project_id", "app_type",
        "flow_id", "is_first")


def plannable(tasks: DataFrame) -> DataFrame:
    """Submitted, live tasks of projects that are not paused, with their rules."""
    rows = tasks.where((F.col("submit_status") == 1) & (F.col("is_deleted") == 0))
    if "project_schedule_status" in tasks.columns:
        rows = rows.where(F.col("project_schedule_status") == 0)
    return parse_rules(rows)


def _clip(triggers: DataFrame, begin: str | None, end: str | None) -> DataFrame:
    if begin is None or end is None:
        return triggers
    clock = F.date_format("trigger", "HH:mm")
    rule = F.col("rule").withField("self_reliance", F.lit(dims.DEPENDENCY["NONE"]))
    return triggers.where((clock >= begin) & (clock <= end)).withColumn("rule", rule)


def plan_day(tasks: DataFrame, day: dt.date, begin: str | None = None, end: str | None = None,
             last: dt.date | None = None) -> DataFrame:
    """Instance rows of a day (or of ``day`` … ``last``), optionally clipped to ``HH:mm`` … ``HH:mm``."""
    triggers = _clip(expand(plannable(tasks), day, last or day), begin, end)
    name = F.concat(F.lit(f"{CRON_NAME}_"), "name")
    return _instances(triggers, F.lit(CRON_PREFIX), name, None, dims.SCHEDULE["NORMAL"])


def plan_task(tasks: DataFrame, task_id: int, day: dt.date) -> DataFrame:
    """The plan of one task and, if it is a workflow, of its members."""
    return plan_day(tasks.where((F.col("task_id") == task_id) | (F.col("flow_id") == task_id)), day)


def plan_backfill(tasks: DataFrame, tree: DataFrame, first: dt.date, last: dt.date, fill_name: str, fill_id: int,
                  today: dt.date, begin: str | None = None, end: str | None = None,
                  ) -> tuple[DataFrame, DataFrame]:
    """(instances, edges) for business days [first, last] of a task tree (task_id, parent_task_id or null for roots).

    The cycle day is the business day plus one. Roots get no parent edges,
    descendants always get theirs, members of chosen workflows come along.
    """
    if "-" in fill_name:
        raise ValueError("a backfill name must not contain '-'")
    if last >= today:
        raise ValueError("the last business day must lie before today")
    one = dt.timedelta(days=1)
    chosen = tree.select("task_id").distinct()
    with_members = chosen.unionByName(
        tasks.join(chosen.select(F.col("task_id").alias("flow_id")).hint("merge"), "flow_id", "left_semi").select("task_id")).distinct()
    rules = parse_rules(tasks.where("is_deleted = 0").join(with_members.hint("merge"), "task_id", "left_semi"))
    triggers = _clip(expand(rules, first + one, last + one, normal=False), begin, end)
    prefix = F.lit(f"{BACKFILL_PREFIX}_{fill_name}")
    rows = _instances(triggers, prefix, F.col("name"), F.lit(fill_name), dims.SCHEDULE["FILL"]).withColumn(
        "fill_id", F.lit(fill_id))
    links = tree.where(F.col("parent_task_id").isNotNull()).select("task_id", "parent_task_id").distinct()
    edges = align_parent(rows, links, tasks, prefix).select("job_key", "parent_job_key")
    return rows, edges


def with_next(instances: DataFrame, limit: int | None = None) -> DataFrame:
    """Next trigger of each minute or hour instance of a task, from the instance rows themselves."""
    out = neighbour(instances, ["task_id", "type"], ["cyc_ts", "id"], ["cyc_time"], "_next", following=True,
                    limit=limit)
    following = F.when(F.col("period_type").isin(0, 1), F.col("_next.cyc_time"))
    return out.withColumn("next_cyc", following).drop("_next")


def previous_trigger(instances: DataFrame, tasks: DataFrame) -> DataFrame:
    """Adds ``prev_ts``, the trigger of the same rule before each instance, whether or not it has an instance."""
    rules = parse_rules(tasks).where(F.col("rule_error").isNull()).select("task_id", "rule")
    return instances.join(rules.hint("merge"), "task_id", "inner").withColumn(
        "prev_ts", trigger_before("rule", "cyc_ts")).drop("rule")


def align_parent(children: DataFrame, edges: DataFrame, tasks: DataFrame, prefix: Column | None = None) -> DataFrame:
    """For each child instance and parent task the parent's latest trigger at or before the child.

    A day parent under a day child is always the one of the same day. Parent id
    -1 and parents without a usable rule give no row.
    """
    # a rule that fires at all has a last trigger, so nothing needs to be filtered after the joins
    parents = parse_rules(tasks.where("is_deleted = 0")).where(
        F.expr("rule_error IS NULL AND rule.slots >= 0 AND (rule.period < 3 OR array_max(rule.days) IS NOT NULL)")).select(
        F.col("task_id").alias("parent_task_id"), F.col("id").alias("_parent_shade"), F.col("rule").alias("_rule"))
    links = edges.where(F.col("parent_task_id") != -1).select("task_id", "parent_task_id").join(
        parents.hint("merge"), "parent_task_id", "inner")
    r, at = F.col("_rule"), F.col("cyc_ts")
    same_day = (r["period"] == dims.PERIOD["DAY"]) & (F.col("period_type") == dims.PERIOD["DAY"])
    aligned = F.when(same_day, _at(at.cast("date"), r["first"])).otherwise(last_trigger("_rule", "cyc_ts"))
    rows = children.select("job_key", "task_id", "cyc_ts", "period_type").join(links.hint("merge"), "task_id", "inner").withColumn(
        "parent_ts", aligned)
    key = job_key(prefix if prefix is not None else F.lit(CRON_PREFIX), F.col("_parent_shade"),
                  F.date_format("parent_ts", STAMP))
    return rows.select("job_key", "task_id", "cyc_ts", "parent_task_id", "parent_ts", key.alias("parent_job_key"))


def parent_edges(instances: DataFrame, edges: DataFrame, tasks: DataFrame, existing: DataFrame,
                 schedule_type: int = 0) -> DataFrame:
    """Edges to aligned parents. Normal runs keep a parent of another day only if that instance exists."""
    aligned = align_parent(instances, edges, tasks)
    if schedule_type == dims.SCHEDULE["FILL"]:
        return aligned.select("job_key", "parent_job_key")
    same = F.col("cyc_ts").cast("date") == F.col("parent_ts").cast("date")
    there = existing.select(F.col("job_key").alias("parent_job_key"), F.lit(True).alias("_there")).distinct()
    return aligned.join(there.hint("merge"), "parent_job_key", "left").where(same | F.col("_there")).select("job_key", "parent_job_key")


def self_edges_of(instances: DataFrame, tasks: DataFrame, existing: DataFrame) -> DataFrame:
    """Edge to the previous period of each self-dependent instance; the first of a day only if that one exists."""
    rows = previous_trigger(instances.where(F.col("dependency_type") != 0), tasks.select("task_id", "schedule_conf"))
    shade = tasks.select("task_id", F.col("id").alias("_shade"))
    rows = rows.where(F.col("prev_ts").isNotNull()).join(shade.hint("merge"), "task_id", "inner").select(
        "job_key", job_key(F.lit(CRON_PREFIX), F.col("_shade"), F.date_format("prev_ts", STAMP)).alias(
            "parent_job_key"), "is_first")
    there = existing.select(F.col("job_key").alias("parent_job_key"), F.lit(True).alias("_there")).distinct()
    return rows.join(there.hint("merge"), "parent_job_key", "left").where(~F.col("is_first") | F.col("_there")).select("job_key", "parent_job_key")


def attach_flows(instances: DataFrame, edges: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instances with flow_job_id, entry edges). Members join the flow instance of the same cycle (minute, hour)
    or the first one of the day (others); unresolved is '0'. Members without parents get an edge to the flow."""
    day = F.col("cyc_ts").cast("date")
    flows = instances.where(F.col("task_type").isin(dims.FLOW_TYPES)).select(
        F.col("task_id").alias("flow_id"), "cyc_ts", F.col("job_id").alias("_flow_job"))
    first = flows.groupBy("flow_id", F.col("cyc_ts").cast("date").alias("_day")).agg(
        F.min("cyc_ts").alias("_first"))
    # plain instances all have flow id 0 and stay out of the joins
    members = instances.where(F.col("flow_id") > 0).withColumn("_day", day).join(first.hint("merge"), ["flow_id", "_day"], "left")
    members = members.withColumn(
        "_at", F.when(F.col("period_type").isin(0, 1), F.col("cyc_ts")).otherwise(F.col("_first")))
    found = members.join(flows.withColumnRenamed("cyc_ts", "_at").hint("merge"), ["flow_id", "_at"], "left").select(
        *instances.columns, F.coalesce("_flow_job", F.lit("0")).alias("flow_job_id"))
    plain = instances.where(F.col("flow_id") <= 0).withColumn("flow_job_id", F.lit("0"))
    entries = instances.where(F.col("flow_id") > 0).join(
        edges.select("task_id").distinct().hint("merge"), "task_id", "left_anti")
    links = entries.select("task_id", F.col("flow_id").alias("parent_task_id")).distinct()
    entry_edges = align_parent(entries, links, tasks).select("job_key", "parent_job_key")
    return found.unionByName(plain), entry_edges


def pick_window(now: dt.datetime, kind: str, day_gap: int = 0, hours: Sequence[int] = (24, 1440, 1440),
                ) -> tuple[str, str]:
    """Cycle-time bounds of candidates: ``normal`` by days, ``min_id``, ``fill`` and ``restart`` by whole hours."""
    end = now.strftime("%Y%m%d%H%M%S")
    hour = now.replace(minute=0, second=0, microsecond=0)
    if kind == "normal":
        start = hour.replace(hour=0) - dt.timedelta(days=day_gap)
    elif kind in ("min_id", "fill", "restart"):
        start = hour - dt.timedelta(hours=hours[("min_id", "fill", "restart").index(kind)])
    else:
        raise ValueError(f"unknown kind {kind}")
    return start.strftime("%Y%m%d%H%M%S"), end

"""Filters, keys, audit and paging (B), top lists and paging (E)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsframe.functions import keys
from opsframe.operators import filters, joins, jobs
from opsframe.suite import query

JOB = "id, task_id, status, cyc_time"
JOB_COLS = ["id", "task_id", "status", "cyc_time"]


@query("b01_filter_by", "SELECT id, project_id, period_type FROM jobs WHERE type = 0 AND period_type IN (0, 1, 3)")
def _(f):
    return filters.filter_by(f.jobs, type=0, period_type=[0, 1, 3], project_id=None, status=[]).select(
        "id", "project_id", "period_type")


@query("b02_search_name", """
SELECT 'fuzzy' AS mode, task_id FROM tasks WHERE contains(name, '00042')
UNION ALL SELECT 'precise', task_id FROM tasks WHERE name = 'Customer#000000042'
UNION ALL SELECT 'front', task_id FROM tasks WHERE starts_with(name, 'Customer#0000004')
UNION ALL SELECT 'tail', task_id FROM tasks WHERE ends_with(name, '42')
UNION ALL SELECT 'other', task_id FROM tasks WHERE contains(name, '%')
""")
def _(f):
    tasks, parts = f.tasks, []
    for mode, text in [("fuzzy", "00042"), ("precise", "Customer#000000042"), ("front", "Customer#0000004"),
                       ("tail", "42"), ("other", "%")]:
        parts.append(filters.search_name(tasks, "name", text, mode).select(F.lit(mode).alias("mode"), "task_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("b03_dependency_candidates", """
SELECT task_id, name, owner_user_id FROM tasks WHERE submit_status = 1 AND is_deleted = 0 AND flow_id = 0
AND contains(name, '7') AND task_id NOT IN (SELECT parent_task_id FROM task_edges)
""")
def _(f):
    used = f.task_edges.select(F.col("parent_task_id").alias("task_id"))
    return filters.dependency_candidates(f.tasks, None, "7", used)


@query("b04_between_days", """
SELECT id FROM jobs WHERE CAST(cyc_ts AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'
""")
def _(f):
    return filters.between_days(f.jobs, "cyc_ts", dt.date(1997, 3, 1), dt.date(1998, 2, 28)).select("id")


@query("b05_visible_tasks", """
SELECT task_id FROM (SELECT *, CASE WHEN owner_user_id < 12 THEN 1 ELSE 0 END AS pub FROM tasks) t
WHERE CASE WHEN pub = 0 THEN is_deleted = 0 ELSE TRUE END
""")
def _(f):
    tasks = f.tasks.withColumn("is_publish_to_produce", F.when(F.col("owner_user_id") < 12, 1).otherwise(0))
    return filters.visible_tasks(tasks).select("task_id")


@query("b06_filter_status", """
SELECT 'merged' AS form, id, status FROM jobs WHERE status IN (8, 9, 21, 22, 7, 13, 24, 26)
UNION ALL SELECT 'split', id, status FROM jobs WHERE status IN (8, 22, 21)
""")
def _(f):
    merged = filters.filter_status(f.jobs, [8, 7, 99]).select(F.lit("merged").alias("form"), "id", "status")
    split = filters.filter_status(f.jobs, [8, 21], split=True).select(F.lit("split").alias("form"), "id", "status")
    return merged.unionByName(split)


@query("b07_biz_window", """
SELECT id, business_date, cyc_time FROM job_runs
WHERE business_date >= '19970101000000' AND business_date < '19980101000000'
  AND cyc_time >= '19970102000000' AND cyc_time < '19980102000000'
""")
def _(f):
    return filters.in_biz_window(f.job_runs, dt.date(1997, 1, 1), dt.date(1997, 12, 31)).select(
        "id", "business_date", "cyc_time")


_KEYED_EDGES = """
SELECT e.job_id, c.job_key, p.job_key AS parent_job_key FROM job_edges e
JOIN job_runs c ON c.job_id = e.job_id JOIN job_runs p ON p.job_id = e.parent_job_id
"""


def keyed_edges(f):
    runs = f.job_runs
    child = runs.select("job_id", "job_key")
    parent = runs.select(F.col("job_id").alias("parent_job_id"), F.col("job_key").alias("parent_job_key"))
    return f.job_edges.join(child, "job_id").join(parent, "parent_job_id").select(
        "job_id", "job_key", "parent_job_key")


@query("b08_self_edges", f"""
SELECT job_id, job_key, parent_job_key FROM ({_KEYED_EDGES}) e
WHERE left(job_key, length(job_key) - 15) = left(parent_job_key, length(parent_job_key) - 15)
""")
def _(f):
    return filters.self_edges(keyed_edges(f))


@query("b09_valid_savepoints", """
SELECT id FROM (SELECT id, concat(checkpoint_savepath, '/savepoint-abcdef12-', lpad(CAST(id AS VARCHAR), 6, '0'),
  '-', CASE WHEN event_type = 'view' THEN 'short' ELSE '0123456789ab' END) AS p
  FROM checkpoints JOIN events ON id = event_id) c
WHERE regexp_matches(p, '^hdfs.*[a-zA-Z0-9]{8}-[a-zA-Z0-9]{6}-[a-zA-Z0-9]{12}$')
""")
def _(f):
    kinds = f.events.select(F.col("event_id").alias("id"), "event_type")
    path = F.concat("checkpoint_savepath", F.lit("/savepoint-abcdef12-"), F.lpad(F.col("id").cast("string"), 6, "0"),
                    F.when(F.col("event_type") == "view", "-short").otherwise("-0123456789ab"))
    rows = f.checkpoints.join(kinds, "id").withColumn("checkpoint_savepath", path)
    return filters.valid_savepoints(rows).select("id")


@query("b10_checkpoints_between", """
SELECT id, task_id FROM checkpoints WHERE is_deleted = 0 AND checkpoint_savepath IS NOT NULL
AND checkpoint_trigger BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'
""")
def _(f):
    return filters.checkpoints_between(
        f.checkpoints, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20, 12)).select("id", "task_id")


@query("b11_failed_checkpoints", """
SELECT id, task_id, checkpoint_trigger FROM checkpoints WHERE checkpoint_savepath IS NULL
""")
def _(f):
    return filters.failed_checkpoints(f.checkpoints).select("id", "task_id", "checkpoint_trigger")


@query("b12_match_labels", """
SELECT metric, job_id, subtask_index, ts FROM samples
WHERE metric <> 'view' AND regexp_full_match(CAST(subtask_index AS VARCHAR), '[0-2]')
AND NOT regexp_full_match(CAST(job_id AS VARCHAR), '1.*')
""")
def _(f):
    labels = F.map_from_arrays(
        F.array(F.lit("metric"), F.lit("job_id"), F.lit("subtask_index")),
        F.array("metric", F.col("job_id").cast("string"), F.col("subtask_index").cast("string")))
    rows = f.samples.withColumn("labels", labels)
    return filters.match_labels(rows, [
        ("metric", "!=", "view"), ("subtask_index", "=~", "[0-2]"), ("job_id", "!~", "1.*"),
        ("absent", "=", "")]).select("metric", "job_id", "subtask_index", "ts")


@query("b13_decode_job_key", """
SELECT id, task_id AS key_task, cyc_time AS key_cyc, left(cyc_time, 8) AS key_day, 0 AS key_type FROM job_runs
""")
def _(f):
    k = keys.decode_job_key(F.col("job_key"))
    return f.job_runs.select("id", k["task_shade_id"].alias("key_task"), k["cyc_time"].alias("key_cyc"),
                             k["day"].alias("key_day"), k["type"].alias("key_type"))


@query("b14_encode_job_key", """
SELECT id, concat('cronTrigger_', task_id, '_', cyc_time) AS k, concat('task', task_id, '_', cyc_time) AS n,
concat('fill', fill_id, '-task', task_id, '-', cyc_time) AS fn FROM job_runs
""")
def _(f):
    dashed = F.date_format("cyc_ts", "yyyy-MM-dd HH:mm:ss")
    task = F.concat(F.lit("task"), F.col("task_id").cast("string"))
    return f.job_runs.select(
        "id", keys.job_key(F.lit("cronTrigger"), F.col("task_id"), dashed).alias("k"),
        keys.job_name(task, dashed).alias("n"),
        keys.job_name(task, dashed, F.concat(F.lit("fill"), F.col("fill_id").cast("string"))).alias("fn"))


@query("b15_task_name", """
SELECT id, CASE WHEN type = 1 THEN concat('task', task_id) ELSE concat('a_', task_id) END AS task_name FROM job_runs
""")
def _(f):
    task = F.col("task_id").cast("string")
    name = F.when(F.col("type") == 1, F.concat(F.lit("fill-task"), task, F.lit("-"), "cyc_time")).otherwise(
        F.concat(F.lit("job_a_"), task, F.lit("_"), "cyc_time"))
    return f.job_runs.select("id", keys.task_name(name, F.col("type")).alias("task_name"))


@query("b16_audit_search", """
SELECT id, operator, operation FROM audit WHERE contains(operator, '1') AND operation = 'purchase'
AND gmt_create >= TIMESTAMP '2024-01-03 00:00:00' AND gmt_create <= TIMESTAMP '2024-01-28 00:00:00'
AND contains(operation_object, '4')
""")
def _(f):
    return filters.audit_search(
        f.audit, operator="1", operation="purchase", operation_object="4", start=dt.datetime(2024, 1, 3),
        end=dt.datetime(2024, 1, 28)).select("id", "operator", "operation")


@query("b17_select_profile", "SELECT id, task_id, name, task_type, project_id, app_type, owner_user_id, period_type, "
       "is_deleted FROM tasks")
def _(f):
    return f.tasks.select(*filters.PROFILES["simple"])


@query("b18_search_jobs", """
SELECT id, status FROM job_runs WHERE type = 0 AND is_deleted = 0 AND status IN (8, 22, 9, 7, 13, 24, 26)
AND task_id IN (SELECT task_id FROM tasks WHERE contains(name, '1') AND owner_user_id = 7)
ORDER BY gmt_modified DESC, id LIMIT 50
""")
def _(f):
    return jobs.search_jobs(f.job_runs, f.tasks, name="1", owner=7, groups=[8, 9, 7], size=50).select("id", "status")


@query("b18_search_jobs_total", """
WITH x AS (SELECT * FROM job_runs WHERE type = 0 AND is_deleted = 0 AND project_id = 3),
plain AS (SELECT * FROM x WHERE flow_job_id = '0'),
members AS (SELECT * FROM x WHERE task_type IN (0, 10) AND cyc_ts >= TIMESTAMP '1995-01-01' AND cyc_ts < TIMESTAMP '1996-01-01')
SELECT 'parents' AS kind, count(*) AS total FROM plain UNION ALL SELECT 'members', count(*) FROM members
""")
def _(f):
    """A project alone shows flow parents and plain instances, task types and days show members, too."""
    parents = jobs.search_jobs(f.job_runs, f.tasks, project_id=3, paged=False)
    members = jobs.search_jobs(f.job_runs, f.tasks, project_id=3, task_type=[0, 10], cyc_start=dt.date(1995, 1, 1),
                               cyc_end=dt.date(1995, 12, 31), paged=False)
    return jobs.count_found(parents).withColumn("kind", F.lit("parents")).unionByName(
        jobs.count_found(members).withColumn("kind", F.lit("members")))


@query("b19_search_tasks", """
SELECT id, name, (SELECT count(*) FROM tasks WHERE submit_status = 1 AND is_deleted = 0) AS published
FROM tasks WHERE is_deleted = 0 AND period_type IN (0, 1) AND contains(name, '3') ORDER BY id DESC LIMIT 25 OFFSET 25
""")
def _(f):
    return jobs.search_tasks(f.tasks, "3", number=2, size=25, period_type=[0, 1]).select("id", "name", "published")


@query("b20_fill_records", """
SELECT id, job_id, fill_id, task_id, CASE WHEN status IN (8, 9, 21, 22) THEN 8 WHEN status IN (5, 12) THEN 5
WHEN status IN (4, 15) THEN 4 WHEN status IN (1, 2, 3, 11, 14, 16, 17, 19, 20, 23, 25) THEN 16
WHEN status IN (24, 26) THEN 24 WHEN status IN (7, 13) THEN 7 ELSE status END AS show_status,
strftime(cyc_ts, '%Y-%m-%d') AS day,
CASE WHEN exec_time = 0 THEN '0秒' ELSE concat(
  CASE WHEN exec_time // 3600 > 0 THEN concat(exec_time // 3600, '小时') ELSE '' END,
  CASE WHEN exec_time // 60 % 60 > 0 THEN concat(exec_time // 60 % 60, '分钟') ELSE '' END,
  CASE WHEN exec_time % 60 > 0 THEN concat(exec_time % 60, '秒') ELSE '' END) END AS run_time, flow_job_id
FROM job_runs WHERE type = 1 AND is_deleted = 0 AND period_type IN (0, 1, 2, 3, 4)
""")
def _(f):
    return jobs.fill_records(f.job_runs, f.tasks, period_type=[0, 1, 2, 3, 4])


@query("b21_jobs_of_cycle", """
SELECT id, cyc_time FROM job_runs WHERE type = 0 AND starts_with(cyc_time, '1998') AND starts_with(job_name, 'task1')
""")
def _(f):
    return filters.jobs_of_cycle(f.job_runs, "1998", "task1").select("id", "cyc_time")


@query("b22_flow_rows", """
SELECT 'parents' AS mode, id FROM jobs WHERE flow_job_id = '0'
UNION ALL SELECT 'no_parents', id FROM jobs WHERE task_type <> 10
UNION ALL SELECT 'all', id FROM jobs
""")
def _(f):
    j = f.jobs
    a, b, c = (filters.flow_rows(j, m).select(F.lit(m).alias("mode"), "id") for m in ("parents", "no_parents", "all"))
    return a.unionByName(b).unionByName(c)


# --- E -------------------------------------------------------------------------------------------

@query("e01_top_run_time", """
SELECT id, task_id, strftime(cyc_ts, '%Y-%m-%d %H:%M:%S') AS cyc_time, type, task_type, exec_time,
concat(CASE WHEN exec_time // 3600 > 0 THEN concat(exec_time // 3600, '小时') ELSE '' END,
  CASE WHEN exec_time // 60 % 60 > 0 THEN concat(exec_time // 60 % 60, '分钟') ELSE '' END,
  CASE WHEN exec_time % 60 > 0 THEN concat(exec_time % 60, '秒') ELSE '' END) AS run_time
FROM job_runs WHERE exec_start_time >= TIMESTAMP '1996-01-01 00:00:00'
AND exec_start_time < TIMESTAMP '2001-01-01 00:00:00' ORDER BY exec_time DESC, id LIMIT 10
""")
def _(f):
    return jobs.top_run_time(f.job_runs, dt.datetime(1996, 1, 1), dt.datetime(2001, 1, 1))


@query("e02_top_errors", """
SELECT task_id, count(*) AS errors FROM job_runs WHERE cyc_time >= '19980601000000' AND status IN (8, 9, 21, 22)
AND type = 0 GROUP BY task_id ORDER BY errors DESC, task_id LIMIT 10
""")
def _(f):
    return jobs.top_errors(f.job_runs, dt.date(1998, 7, 1))


@query("e03_page", "SELECT id, exec_time FROM jobs ORDER BY exec_time DESC, id LIMIT 100 OFFSET 300")
def _(f):
    return filters.page(f.jobs, "exec_time", 4, 100).select("id", "exec_time")


@query("e04_keyset", "SELECT id, status FROM jobs WHERE id > 500 ORDER BY id LIMIT 200")
def _(f):
    return filters.keyset(f.jobs, 500, 200).select("id", "status")


@query("e05_sort_jobs", "SELECT id, exec_time, cyc_time, retry_num FROM job_runs")
def _(f):
    return filters.sort_jobs(f.job_runs, [("exec_time", False), ("cyc_time", True), ("retry_num", True)]).select(
        "id", "exec_time", "cyc_time", "retry_num")


@query("e06_latest_checkpoint", """
SELECT 'run' AS kind, task_engine_id AS k, id, checkpoint_savepath FROM checkpoints
WHERE is_deleted = 0 AND checkpoint_savepath IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY task_engine_id ORDER BY checkpoint_id DESC) = 1
UNION ALL
SELECT 'task', CAST(task_id AS VARCHAR), id, checkpoint_savepath FROM checkpoints
WHERE is_deleted = 0 AND checkpoint_savepath IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY checkpoint_id DESC) = 1
""")
def _(f):
    cp = f.checkpoints
    run = jobs.latest_checkpoint(cp, "task_engine_id").select(
        F.lit("run").alias("kind"), F.col("task_engine_id").alias("k"), "id", "checkpoint_savepath")
    task = jobs.latest_checkpoint(cp, "task_id").select(
        F.lit("task").alias("kind"), F.col("task_id").cast("string").alias("k"), "id", "checkpoint_savepath")
    return run.unionByName(task)


@query("e07_expire_checkpoints", """
WITH t AS (SELECT task_engine_id, checkpoint_id AS t FROM checkpoints WHERE checkpoint_savepath IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY task_engine_id ORDER BY checkpoint_id DESC) = 5)
SELECT id, CASE WHEN checkpoint_id < t THEN 1 ELSE is_deleted END AS is_deleted
FROM checkpoints LEFT JOIN t USING (task_engine_id)
""")
def _(f):
    return jobs.expire_checkpoints(f.checkpoints, 5).select("id", "is_deleted")


@query("e08_recent_runs", """
SELECT task_id, id, exec_time FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY business_date DESC, id DESC) AS rn
  FROM job_runs WHERE status IN (5, 12)) r WHERE rn <= 3 AND exec_time <> 0
""")
def _(f):
    return jobs.recent_runs(f.job_runs, n=3).select("task_id", "id", "exec_time")


@query("e09_recent_stats", """
SELECT task_id, id, status, exec_time FROM jobs
QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY cyc_ts DESC, id DESC) <= 4
""")
def _(f):
    return jobs.recent_stats(f.jobs, 4)


@query("e10_neighbour_periods", """
SELECT false AS is_after, a.id AS of_id, b.id, strftime(b.cyc_ts, '%Y-%m-%d %H:%M:%S') AS cyc_time, b.status
FROM jobs a JOIN jobs b ON a.task_id = b.task_id AND a.type = b.type AND b.cyc_ts < a.cyc_ts
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.cyc_ts DESC, b.id DESC) <= 3
UNION ALL
SELECT true, a.id, b.id, strftime(b.cyc_ts, '%Y-%m-%d %H:%M:%S'), b.status
FROM jobs a JOIN jobs b ON a.task_id = b.task_id AND a.type = b.type AND b.cyc_ts > a.cyc_ts
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.cyc_ts DESC, b.id DESC) <= 3
""")
def _(f):
    out = []
    for after in (False, True):
        out.append(jobs.neighbour_periods(f.job_runs, after, 3).select(
            F.lit(after).alias("is_after"), "of_id", "id", "cyc_time", "status"))
    return out[0].unionByName(out[1])


@query("e12_version_changes", """
SELECT * FROM (SELECT id, task_id, version_id, lag(version_id) OVER (PARTITION BY task_id ORDER BY id)
  AS prev_version_id FROM jobs) v WHERE version_id <> prev_version_id
""")
def _(f):
    return joins.version_changes(f.jobs).select("id", "task_id", "version_id", "prev_version_id")


@query("e13_last_retries", """
SELECT job_id, id FROM checkpoints JOIN (SELECT event_id AS id, user_id AS job_id FROM events) USING (id)
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY id DESC) <= 5
""")
def _(f):
    return jobs.last_retries(f.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("job_id"))).select(
        "job_id", "id")


@query("e14_first_child", f"""
SELECT e.parent_job_key, c.task_id, min_by(e.job_key, c.cyc_time || e.job_key) AS job_key
FROM ({_KEYED_EDGES}) e JOIN job_runs c ON c.job_id = e.job_id GROUP BY ALL
""")
def _(f):
    child = f.job_runs.select("job_id", "task_id", "cyc_time")
    return jobs.first_child(keyed_edges(f).join(child, "job_id"))


@query("e15_queue_order", """
SELECT job_id, stage, CASE WHEN job_priority > 0 THEN job_priority
  ELSE epoch_ms(gmt_create) + 10 * 100000 END AS priority FROM queue
""")
def _(f):
    return jobs.queue_order(f.queue).select("job_id", "stage", "priority")


@query("e16_stick", """
WITH c AS (SELECT max(job_id) AS job_id FROM queue GROUP BY job_resource),
m AS (SELECT job_resource, min(job_priority) AS mp FROM queue WHERE is_deleted = 0 GROUP BY 1)
SELECT job_id, job_resource, CASE WHEN job_id IN (SELECT job_id FROM c) THEN mp - 1 ELSE job_priority END
AS job_priority FROM queue JOIN m USING (job_resource)
""")
def _(f):
    chosen = f.queue.groupBy("job_resource").agg(F.max("job_id").alias("job_id"))
    return jobs.stick(f.queue, chosen).select("job_id", "job_resource", "job_priority")


@query("e18_sort_instances", "SELECT id, cyc_time FROM job_runs")
def _(f):
    return filters.sort_instances(f.job_runs).select("id", "cyc_time")


@query("e19_changed_since", """
SELECT id FROM job_runs WHERE compute_type = 1 AND gmt_modified >= TIMESTAMP '1998-01-01 00:00:00'
""")
def _(f):
    return filters.changed_since(f.job_runs, dt.datetime(1998, 1, 1), 1).select("id")

"""Statistics, charts, roll-ups (D)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsframe.functions.status import show_status, status_code
from opsframe.operators import jobs
from opsframe.suite import query

_MERGED = """
SELECT * FROM (VALUES ('UNSUBMIT', [0]), ('RUNNING', [4, 15]), ('FINISHED', [5, 12]), ('FAILED', [8, 9, 21, 22]),
('WAITENGINE', [1, 2, 3, 11, 14, 16, 17, 19, 20, 23, 25]), ('SUBMITTING', [10]), ('CANCELED', [7, 13, 24, 26]),
('FROZEN', [18])) AS g(bucket, members)
"""
_SPLIT = """
SELECT * FROM (VALUES ('UNSUBMIT', [0]), ('RUNNING', [4, 15]), ('FINISHED', [5, 12]), ('FAILED', [8, 22]),
('SUBMITFAILD', [9]), ('PARENTFAILED', [21]),
('WAITENGINE', [1, 2, 3, 11, 14, 16, 17, 19, 20, 23, 25]), ('SUBMITTING', [10]), ('CANCELED', [7, 13, 24, 26]),
('FROZEN', [18])) AS g(bucket, members)
"""


@query("d01_count_by_status", """
SELECT status, count(*) AS cnt FROM job_runs WHERE type = 0 AND app_type = 1 AND cyc_time >= '19960101000000'
AND cyc_time < '20010101000000' GROUP BY status
""")
def _(f):
    return jobs.count_by_status(f.job_runs, "19960101000000", "20010101000000", type=0, app_type=1)


@query("d02_status_buckets", f"""
SELECT bucket, count(id) AS cnt, (SELECT count(*) FROM jobs WHERE status <> 6) AS total
FROM ({_MERGED}) g LEFT JOIN jobs ON list_contains(members, status) GROUP BY bucket
""")
def _(f):
    return jobs.status_buckets(f.jobs)


@query("d03_status_statistics", f"""
SELECT bucket, count(id) AS cnt FROM ({_SPLIT}) g LEFT JOIN (SELECT * FROM jobs WHERE task_type <> 10) j
ON list_contains(members, status) GROUP BY bucket
UNION ALL SELECT 'ALL', count(*) FROM jobs WHERE task_type <> 10 AND status <> 6
""")
def _(f):
    return jobs.status_statistics(f.jobs)


@query("d04_status_buckets_by_project", f"""
WITH p AS (SELECT DISTINCT project_id FROM jobs)
SELECT p.project_id, bucket, count(id) AS cnt,
(SELECT count(*) FROM jobs j2 WHERE j2.project_id = p.project_id AND status <> 6) AS total
FROM p CROSS JOIN ({_MERGED}) g LEFT JOIN jobs j ON j.project_id = p.project_id AND list_contains(members, status)
GROUP BY p.project_id, bucket
""")
def _(f):
    return jobs.status_buckets(f.jobs, by="project_id")


@query("d05_show_status", """
SELECT id, CASE WHEN status IN (8, 9, 21, 22) THEN 8 ELSE s END AS merged, s AS kept FROM (
SELECT id, status, CASE WHEN status IN (5, 12) THEN 5 WHEN status IN (4, 15) THEN 4
WHEN status IN (1, 2, 3, 11, 14, 16, 17, 19, 20, 23, 25) THEN 16
WHEN status IN (24, 26) THEN 24 WHEN status IN (7, 13) THEN 7 ELSE status END AS s FROM jobs) t
""")
def _(f):
    s = F.col("status")
    return f.jobs.select("id", show_status(s).alias("merged"), show_status(s, False).alias("kept"))


@query("d06_status_code", f"""
SELECT id, coalesce(bucket, 'UNSUBMIT') AS code FROM jobs LEFT JOIN ({_SPLIT}) g ON list_contains(members, status)
""")
def _(f):
    return f.jobs.select("id", status_code(F.col("status")).alias("code"))


@query("d07_queue_summary", """
SELECT job_resource, stage, CAST(epoch(min(gmt_create)) AS BIGINT) AS generate_time, count(*) AS job_size
FROM queue WHERE is_deleted = 0 GROUP BY job_resource, stage
""")
def _(f):
    return jobs.queue_summary(f.queue)


def _wait(stage: int) -> str:
    secs = (f"CAST(epoch(TIMESTAMP '2002-01-01 10:20:30') - epoch(min(gmt_create) FILTER (stage = {stage})) AS BIGINT)")
    return f"""CASE WHEN count(*) FILTER (stage = {stage}) = 0 THEN '' ELSE concat(
    CASE WHEN {secs} // 3600 > 0 THEN concat({secs} // 3600, '小时') ELSE '' END,
    CASE WHEN {secs} // 60 % 60 > 0 THEN concat({secs} // 60 % 60, '分钟') ELSE '' END,
    CASE WHEN {secs} % 60 > 0 THEN concat({secs} % 60, '秒') ELSE '' END) END"""


_STAGES = {"db": 1, "priority": 2, "restart": 3, "lacking": 4, "submitted": 5}


@query("d08_queue_overview", "SELECT job_resource, " + ", ".join(
    f"count(*) FILTER (stage = {s}) AS {n}_size, {_wait(s)} AS {n}_wait" for n, s in _STAGES.items())
    + " FROM queue GROUP BY job_resource")
def _(f):
    return jobs.queue_overview(f.queue, dt.datetime(2002, 1, 1, 10, 20, 30))


@query("c13_dense_pairs", """
SELECT r.job_resource, s.stage, count(q.job_id) AS job_size FROM (SELECT DISTINCT job_resource FROM queue) r
CROSS JOIN (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS stage) s
LEFT JOIN queue q ON q.job_resource = r.job_resource AND q.stage = s.stage GROUP BY 1, 2
""")
def _(f):
    return jobs.dense_pairs(f.queue)


@query("d09_count_tasks", "SELECT project_id, count(*) AS cnt FROM tasks WHERE task_type = 0 AND flow_id = 0 "
       "GROUP BY project_id")
def _(f):
    return jobs.count_tasks(f.tasks, task_type=0, flow_id=0)


@query("d10_count_matching", "SELECT count(*) AS cnt FROM tasks WHERE is_deleted = 0 AND submit_status = 1 "
       "AND period_type IN (0, 1, 2)")
def _(f):
    return f.tasks.where("is_deleted = 0 AND submit_status = 1 AND period_type IN (0, 1, 2)").agg(
        F.count(F.lit(1)).alias("cnt"))


@query("d11_distinct_values", "SELECT DISTINCT job_resource FROM queue WHERE is_deleted = 0")
def _(f):
    return f.queue.where("is_deleted = 0").select("job_resource").distinct()


@query("d12_distinct_fills", "SELECT project_id, count(DISTINCT fill_id) AS fills FROM jobs WHERE type = 1 "
       "AND fill_id > 0 GROUP BY project_id")
def _(f):
    return jobs.distinct_fills(f.jobs, by="project_id", type=1)


@query("d13_science_counts", """
SELECT project_id, count(*) AS total, count(*) FILTER (status IN (0, 10, 16)) AS deployed,
count(*) FILTER (status IN (8, 9)) AS failed, count(*) FILTER (status = 5) AS success
FROM jobs WHERE type = 0 GROUP BY project_id
""")
def _(f):
    return jobs.science_counts(f.jobs, by="project_id", type=0)


def _profile(lo: str, hi: str, div: str = "") -> str:
    return f"""SELECT CAST(h AS INTEGER) AS hour, count(id){div} AS cnt FROM (SELECT unnest(range(24)) AS h) g
LEFT JOIN jobs ON hour(cyc_ts) = h AND cyc_ts >= {lo} AND cyc_ts < {hi} AND type = 0
AND status IN (5, 12, 8, 9, 21, 22) GROUP BY h"""


@query("d14_hourly_profile", _profile("TIMESTAMP '1998-07-01 00:00:00'", "TIMESTAMP '1998-07-02 00:00:00'"))
def _(f):
    return jobs.hourly_profile(f.jobs, dt.date(1998, 7, 1))


@query("d15_hourly_profile_month", _profile("TIMESTAMP '1998-06-01 00:00:00'", "TIMESTAMP '1998-07-02 00:00:00'",
                                            " // 30"))
def _(f):
    return jobs.hourly_profile(f.jobs, dt.date(1998, 7, 1), days=30)


@query("d16_job_chart", """
SELECT CAST(h AS INTEGER) AS hour, count(id) FILTER (cyc_ts >= TIMESTAMP '1998-07-01 00:00:00') AS today,
count(id) FILTER (cyc_ts >= TIMESTAMP '1998-06-30 00:00:00' AND cyc_ts < TIMESTAMP '1998-07-01 00:00:00') AS yesterday,
count(id) // 30 AS month FROM (SELECT unnest(range(24)) AS h) g LEFT JOIN jobs ON hour(cyc_ts) = h
AND cyc_ts >= TIMESTAMP '1998-06-01 00:00:00' AND cyc_ts < TIMESTAMP '1998-07-02 00:00:00' AND type = 0
AND status IN (5, 12, 8, 9, 21, 22) GROUP BY h
""")
def _(f):
    return jobs.job_chart(f.jobs, dt.date(1998, 7, 1))


@query("d17_daily_chart", """
SELECT strftime(d, '%m/%d') AS label, count(id) AS total, count(id) FILTER (status = 5) AS success,
count(id) FILTER (status IN (8, 9)) AS failed, count(id) FILTER (status IN (0, 10, 16)) AS pending
FROM (SELECT unnest(range(TIMESTAMP '1998-06-02', TIMESTAMP '1998-07-02', INTERVAL 1 DAY)) AS d) g
LEFT JOIN jobs ON date_trunc('day', cyc_ts) = d AND type = 0 GROUP BY d
""")
def _(f):
    return jobs.daily_chart(f.jobs, dt.date(1998, 7, 1))


_PROGRESS = """
SELECT f.id, f.job_name, count(j.id) FILTER (status IN (5, 12)) AS finished,
count(j.id) FILTER (status <> 6) AS total,
count(j.id) FILTER (status IN (8, 9, 21, 22, 7, 13, 24, 26, 18, 5, 12)) AS done
FROM fills f LEFT JOIN jobs j ON j.fill_id = f.id AND j.fill_id > 0 GROUP BY f.id, f.job_name
"""


@query("d18_fill_progress", _PROGRESS)
def _(f):
    return jobs.fill_progress(f.jobs, f.fills)


_FLOW_STATUS = """
SELECT f.job_id, CASE WHEN count(m.id) = 0 THEN 5
WHEN bool_or(m.status NOT IN (5, 7, 8, 9, 12, 13, 18, 21, 24, 26)) THEN 4
WHEN bool_and(m.status = 18) THEN 18 WHEN bool_or(m.status IN (8, 22)) THEN 8 WHEN bool_or(m.status = 9) THEN 9
WHEN bool_or(m.status = 21) THEN 21
WHEN arg_max(m.status, m.id) FILTER (m.status IN (7, 13, 24, 26, 18)) = 26 THEN 26
WHEN count(*) FILTER (m.status IN (7, 13, 24, 26, 18)) > 0 THEN 7 ELSE 5 END AS flow_status
FROM jobs f LEFT JOIN jobs m ON m.flow_job_id = f.job_id WHERE f.task_type = 10 GROUP BY f.job_id
"""


@query("d19_workflow_status", _FLOW_STATUS)
def _(f):
    return jobs.workflow_status(f.jobs)


@query("d20_propagate_flow_status", """
SELECT m.id, coalesce(p.status, m.status) AS status FROM jobs m LEFT JOIN jobs p
ON p.job_id = m.flow_job_id AND p.task_type = 10 AND p.status IN (24, 18)
""")
def _(f):
    return jobs.propagate_flow_status(f.jobs).select("id", "status")


@query("d21_min_keys", """
SELECT job_resource AS k, min(job_priority) AS v FROM queue WHERE is_deleted = 0 AND stage IN (1, 2) GROUP BY 1
UNION ALL SELECT 'job', min(id) FROM job_runs WHERE cyc_time BETWEEN '19970101000000' AND '19971231235959'
""")
def _(f):
    a = jobs.min_priority(f.queue, [1, 2]).select(F.col("job_resource").alias("k"), F.col("min_priority").alias("v"))
    b = jobs.min_job_id(f.job_runs, "19970101000000", "19971231235959").select(
        F.lit("job").alias("k"), F.col("min_id").alias("v"))
    return a.unionByName(b)


@query("d22_job_logs", """
SELECT job_id, component, CAST(0 AS BIGINT) AS chunk, concat(repeat('#', 15), component, repeat('#', 15), chr(10),
string_agg(message, chr(10) ORDER BY seq), chr(10), repeat('#', 51), chr(10)) AS text
FROM logs GROUP BY job_id, component
""")
def _(f):
    return jobs.job_logs(f.logs)


@query("d23_nest_workflows", """
WITH m AS (SELECT * FROM jobs WHERE flow_job_id <> '0'), k AS (SELECT m.* FROM m SEMI JOIN jobs f
  ON f.job_id = m.flow_job_id),
l AS (SELECT flow_job_id AS job_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS related FROM k GROUP BY 1)
SELECT j.id, j.job_id, CAST(0 AS BIGINT) AS chunk, related FROM jobs j LEFT JOIN l USING (job_id)
WHERE j.flow_job_id = '0' OR j.id IN (SELECT m.id FROM m ANTI JOIN jobs f ON f.job_id = m.flow_job_id)
""")
def _(f):
    out = jobs.nest_workflows(f.jobs, f.jobs)
    return out.select("id", "job_id", "chunk", F.array_join("related", ",").alias("related"))


@query("d24_tasks_by_app", """
SELECT app_type, CAST(0 AS BIGINT) AS chunk, string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY task_id) AS task_ids
FROM (SELECT DISTINCT app_type, task_id FROM jobs) t GROUP BY app_type
""")
def _(f):
    return jobs.tasks_by_app(f.jobs).select("app_type", "chunk", F.array_join("task_ids", ",").alias("task_ids"))


@query("d32_group_frequent", """
SELECT task_id, strftime(cyc_ts, '%Y-%m-%d') AS day, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids,
true AS grouped FROM jobs WHERE period_type IN (0, 1) GROUP BY 1, 2
UNION ALL SELECT task_id, strftime(cyc_ts, '%Y-%m-%d'), CAST(id AS VARCHAR), false FROM jobs
WHERE period_type NOT IN (0, 1)
""")
def _(f):
    return jobs.group_frequent(f.jobs).select(
        "task_id", F.col("day").cast("string").alias("day"), F.array_join("ids", ",").alias("ids"), "grouped")


@query("d33_fill_preview", f"""
SELECT *, count(*) OVER () AS fill_total FROM ({_PROGRESS}) p
WHERE id IN (SELECT fill_id FROM jobs WHERE fill_id > 0 AND period_type IN (0, 1))
""")
def _(f):
    return jobs.fill_preview(f.fills, f.jobs, period_type=[0, 1])

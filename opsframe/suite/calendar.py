"""Calendar expansion, plans, alignment (G, C9) and readiness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsframe.operators import calendar, filters, readiness
from opsframe.plans.storage import materialise
from opsframe.suite import query

DAY = dt.date(1998, 3, 15)  # a Sunday and a fifteenth: every period type fires


def triggers(first: str, last: str, source: str = "tasks") -> str:
    """All triggers of the fixture rules from ``first`` to ``last``, spelled out per period type."""
    return f"""
SELECT t.*, d + INTERVAL 1 MINUTE * m AS ts, CAST(d AS DATE) AS trigger_day FROM {source} t,
  (SELECT unnest(range(TIMESTAMP '{first}', TIMESTAMP '{last}' + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d) days,
  (SELECT 0 AS p, unnest(range(0, 1440, 30)) AS m UNION ALL SELECT 1, unnest([135, 435, 735, 1035, 1335])
   UNION ALL SELECT 2, 90 UNION ALL SELECT 3, 1380 UNION ALL SELECT 4, 23) slots
WHERE slots.p = t.period_type AND (t.period_type < 3 OR (t.period_type = 3 AND isodow(d) IN (1, 3, 7))
  OR (t.period_type = 4 AND day(d) IN (1, 15, 31)))"""


PLANNABLE = "(SELECT * FROM tasks WHERE submit_status = 1 AND is_deleted = 0)"
PLAN = triggers("1998-03-15", "1998-03-15", PLANNABLE)
_KEY = "concat('cronTrigger_', {0}, '_', strftime({1}, '%Y%m%d%H%M%S'))"


@query("g01_expand_rules", f"""
SELECT task_id, ts AS "trigger" FROM ({triggers('1998-02-27', '1998-03-04')}) x
""")
def _(f):
    return calendar.expand(calendar.parse_rules(_tasks(f)), dt.date(1998, 2, 27), dt.date(1998, 3, 4)).select(
        "task_id", "trigger")


@query("g06_parse_rules", """
SELECT task_id, period_type AS period, CASE period_type WHEN 1 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS self_reliance,
0 AS max_retry, CASE period_type WHEN 3 THEN '1,3,7' WHEN 4 THEN '1,15,31' END AS days,
CASE WHEN period_type = 2 AND owner_user_id > 20 THEN 'beginDate is missing' END AS rule_error FROM tasks
""")
def _(f):
    broken = (F.col("period_type") == 2) & (F.col("owner_user_id") > 20)
    conf = F.when(broken, F.replace(F.col("schedule_conf"), F.lit("beginDate"), F.lit("begin"))).otherwise(
        F.col("schedule_conf"))
    rows = calendar.parse_rules(f.tasks.withColumn("schedule_conf", conf))
    r = F.col("rule")
    return rows.select(
        "task_id", r["period"].cast("long").alias("period"), r["self_reliance"].alias("self_reliance"),
        r["max_retry"].alias("max_retry"),
        F.when(r["days"].isNotNull(), F.array_join(r["days"].cast("array<string>"), ",")).alias("days"), "rule_error")


@query("g07_validity", """
SELECT task_id, count(*) AS n FROM (SELECT task_id, owner_user_id, unnest(range(DATE '1998-03-01', DATE '1998-03-11',
INTERVAL 1 DAY)) AS d FROM tasks WHERE period_type = 2) t
WHERE d >= DATE '1998-03-01' + INTERVAL 1 DAY * (owner_user_id % 5) AND d <= DATE '1998-03-08' GROUP BY task_id
""")
def _(f):
    begin = F.date_format(F.date_add(F.lit(dt.date(1998, 3, 1)), (F.col("owner_user_id") % 5).cast("int")),
                          "yyyy-MM-dd")
    conf = F.replace(F.replace(F.col("schedule_conf"), F.lit("2001-01-01"), begin), F.lit("2121-01-01"),
                     F.lit("1998-03-08"))
    rows = calendar.parse_rules(f.tasks.where("period_type = 2").withColumn("schedule_conf", conf))
    return calendar.expand(rows, dt.date(1998, 3, 1), dt.date(1998, 3, 10)).groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n"))


def _tasks(f):
    """The fixture rules start in 2001; the plans here are for 1998."""
    conf = F.replace(F.col("schedule_conf"), F.lit("2001-01-01"), F.lit("1991-01-01"))
    return f.tasks.withColumn("schedule_conf", conf)


_NEXT = """CASE WHEN period_type = 0 THEN strftime(ts + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S')
WHEN period_type = 1 THEN strftime(ts + CASE WHEN hour(ts) = 22 THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END,
'%Y-%m-%d %H:%M:%S') END"""


@query("g08_plan_day", f"""
SELECT {_KEY.format('id', 'ts')} AS job_key, concat('cronJob_', name, '_', strftime(ts, '%Y%m%d%H%M%S')) AS job_name,
ts AS cyc_ts, strftime(ts - INTERVAL 1 DAY, '%Y%m%d%H%M%S') AS business_date, {_NEXT} AS next_cyc_time,
0 AS status, period_type, version_id FROM ({PLAN}) p
""")
def _(f):
    return calendar.plan_day(_tasks(f), DAY).select(
        "job_key", "job_name", "cyc_ts", "business_date", "next_cyc_time", "status",
        F.col("period_type").cast("long").alias("period_type"), "version_id")


@query("g09_plan_clipped", f"""
SELECT {_KEY.format('id', 'ts')} AS job_key, 0 AS dependency_type FROM ({PLAN}) p
WHERE strftime(ts, '%H:%M') BETWEEN '02:00' AND '12:30'
""")
def _(f):
    return calendar.plan_day(_tasks(f), DAY, "02:00", "12:30").select("job_key", "dependency_type")


@query("g16_plan_task", f"""
SELECT {_KEY.format('id', 'ts')} AS job_key FROM ({PLAN}) p WHERE task_id = 30 OR flow_id = 30
""")
def _(f):
    return calendar.plan_task(_tasks(f), 30, DAY).select("job_key")


@query("g10_previous_trigger", f"""
SELECT {_KEY.format('p.id', 'p.ts')} AS job_key, h.ts AS prev_ts FROM ({PLAN}) p
ASOF JOIN ({triggers('1998-01-01', '1998-03-15')}) h ON h.task_id = p.task_id AND h.ts < p.ts
""")
def _(f):
    return calendar.previous_trigger(calendar.plan_day(_tasks(f), DAY), _tasks(f)).select("job_key", "prev_ts")


def _aligned(day: str, since: str) -> str:
    plan = triggers(day, day, PLANNABLE)
    return f"""
SELECT job_key, parent_task_id, ts, CASE WHEN cp = 2 AND pp = 2 THEN date_trunc('day', ts) + INTERVAL 90 MINUTE
ELSE pts END AS parent_ts FROM (
SELECT {_KEY.format('c.id', 'c.ts')} AS job_key, c.parent_task_id, c.ts, h.ts AS pts, c.period_type AS cp, c.pp
FROM (SELECT c.*, e.parent_task_id, t.period_type AS pp FROM ({plan}) c JOIN task_edges e ON e.task_id = c.task_id
  JOIN tasks t ON t.task_id = e.parent_task_id WHERE t.is_deleted = 0) c
ASOF JOIN ({triggers(since, day)}) h ON h.task_id = c.parent_task_id AND h.ts <= c.ts) a"""


@query("c09_align_parent", f"SELECT job_key, parent_task_id, parent_ts FROM ({_aligned('1998-03-31', '1998-01-01')}) a")
def _(f):
    tasks = _tasks(f)
    return calendar.align_parent(calendar.plan_day(tasks, dt.date(1998, 3, 31)), f.task_edges, tasks).select(
        "job_key", "parent_task_id", "parent_ts")


@query("g12_parent_edges", f"""
WITH a AS ({_aligned('1998-03-15', '1998-01-01')}), x AS ({triggers('1998-03-12', '1998-03-14', PLANNABLE)})
SELECT job_key, {_KEY.format('parent_task_id', 'parent_ts')} AS parent_job_key FROM a
WHERE date_trunc('day', ts) = date_trunc('day', parent_ts)
OR EXISTS (SELECT 1 FROM x WHERE x.task_id = a.parent_task_id AND x.ts = a.parent_ts)
""")
def _(f):
    tasks = _tasks(f)
    existing = calendar.plan_day(tasks, dt.date(1998, 3, 12), last=dt.date(1998, 3, 14))
    return calendar.parent_edges(calendar.plan_day(tasks, DAY), f.task_edges, tasks, existing)


@query("g13_self_edges", f"""
WITH x AS ({triggers('1998-03-14', '1998-03-14', PLANNABLE)}),
p AS (SELECT p.id, p.ts, h.ts AS prev_ts, p.ts = min(p.ts) OVER (PARTITION BY p.task_id) AS is_first
FROM ({PLAN}) p ASOF JOIN ({triggers('1998-01-01', '1998-03-15')}) h ON h.task_id = p.task_id AND h.ts < p.ts
WHERE p.period_type IN (1, 3))
SELECT {_KEY.format('id', 'ts')} AS job_key, {_KEY.format('id', 'prev_ts')} AS parent_job_key FROM p
WHERE NOT is_first OR EXISTS (SELECT 1 FROM x WHERE x.task_id = p.id AND x.ts = p.prev_ts)
""")
def _(f):
    tasks = _tasks(f)
    existing = calendar.plan_day(tasks, dt.date(1998, 3, 14))
    return calendar.self_edges_of(calendar.plan_day(tasks, DAY), tasks, existing)


@query("g14_attach_flows", f"""
WITH p AS (SELECT *, {_KEY.format('id', 'ts')} AS job_key FROM ({PLAN}) x),
w AS (SELECT * FROM p WHERE task_type = 10), first AS (SELECT task_id, min(ts) AS ts FROM w GROUP BY task_id)
SELECT p.job_key, coalesce(md5(w.job_key), '0') AS flow_job_id FROM p
LEFT JOIN first ON first.task_id = p.flow_id
LEFT JOIN w ON w.task_id = p.flow_id AND w.ts = CASE WHEN p.period_type < 2 THEN p.ts ELSE first.ts END
""")
def _(f):
    tasks = _tasks(f)
    rows, _ = calendar.attach_flows(calendar.plan_day(tasks, DAY), f.task_edges, tasks)
    return rows.select("job_key", "flow_job_id")


@query("g14_entry_edges", f"""
WITH e AS (SELECT DISTINCT task_id FROM task_edges WHERE parent_task_id > 100), c AS (
SELECT p.*, t.period_type AS pp FROM ({PLAN}) p JOIN tasks t ON t.task_id = p.flow_id AND t.is_deleted = 0
WHERE p.flow_id > 0 AND p.task_id NOT IN (SELECT task_id FROM e))
SELECT {_KEY.format('c.id', 'c.ts')} AS job_key, {_KEY.format('c.flow_id', '''CASE WHEN c.pp = 2 AND c.period_type = 2
THEN date_trunc('day', c.ts) + INTERVAL 90 MINUTE ELSE h.ts END''')} AS parent_job_key FROM c
ASOF JOIN ({triggers('1998-01-01', '1998-03-15')}) h ON h.task_id = c.flow_id AND h.ts <= c.ts
""")
def _(f):
    tasks = _tasks(f)
    _, entry = calendar.attach_flows(
        calendar.plan_day(tasks, DAY), f.task_edges.where("parent_task_id > 100"), tasks)
    return entry


_TREE = """SELECT task_id, CASE WHEN task_id >= 4 THEN parent_task_id END AS parent_task_id FROM task_edges"""


@query("g15_plan_backfill", f"""
WITH n AS (SELECT DISTINCT task_id FROM task_edges UNION SELECT t.task_id FROM tasks t
  WHERE flow_id IN (SELECT task_id FROM task_edges)),
r AS ({triggers('1998-03-15', '1998-03-17')}),
i AS (SELECT concat('fillData_refill_', id, '_', strftime(ts, '%Y%m%d%H%M%S')) AS job_key,
  concat('refill-', name, '-', strftime(ts, '%Y%m%d%H%M%S')) AS job_name, * FROM r
  WHERE is_deleted = 0 AND task_id IN (SELECT task_id FROM n)),
c AS (SELECT i.*, e.parent_task_id AS p, t.period_type AS pp FROM i JOIN task_edges e ON e.task_id = i.task_id
  JOIN tasks t ON t.task_id = e.parent_task_id AND t.is_deleted = 0 WHERE i.task_id >= 4)
SELECT 'job' AS kind, job_key AS k, job_name AS v FROM i
UNION ALL SELECT 'edge', c.job_key, concat('fillData_refill_', p, '_', strftime(
CASE WHEN c.pp = 2 AND c.period_type = 2 THEN date_trunc('day', c.ts) + INTERVAL 90 MINUTE ELSE h.ts END,
'%Y%m%d%H%M%S')) FROM c ASOF JOIN ({triggers('1998-01-01', '1998-03-17')}) h
ON h.task_id = c.p AND h.ts <= c.ts
""")
def _(f):
    parent = F.when(F.col("task_id") >= 4, F.col("parent_task_id"))
    tree = f.task_edges.select("task_id", parent.alias("parent_task_id"))
    rows, edges = calendar.plan_backfill(
        _tasks(f), tree, dt.date(1998, 3, 14), dt.date(1998, 3, 16), "refill", 7, dt.date(1998, 4, 1))
    return rows.select(F.lit("job").alias("kind"), F.col("job_key").alias("k"), F.col("job_name").alias("v")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("job_key").alias("k"), F.col("parent_job_key").alias("v")))


@query("e11_with_next", """
SELECT id, CASE WHEN period_type IN (0, 1) THEN lead(cyc_time) OVER (PARTITION BY task_id, type ORDER BY cyc_ts, id)
END AS next_cyc FROM job_runs
""")
def _(f):
    return calendar.with_next(f.job_runs).select("id", "next_cyc")


@query("g21_pick_window", """
SELECT id FROM job_runs WHERE type = 0 AND cyc_time >= '19980628000000' AND cyc_time <= '19980701120000'
UNION ALL SELECT id FROM job_runs WHERE type = 1 AND cyc_time >= '19980502120000' AND cyc_time <= '19980701120000'
""")
def _(f):
    now = dt.datetime(1998, 7, 1, 12)
    a, b = calendar.pick_window(now, "normal", day_gap=3), calendar.pick_window(now, "fill")
    runs = f.job_runs
    return runs.where((F.col("type") == 0) & F.col("cyc_time").between(*a)).unionByName(
        runs.where((F.col("type") == 1) & F.col("cyc_time").between(*b))).select("id")


# --- readiness -----------------------------------------------------------------------------------

NOW = dt.datetime(1998, 7, 1, 12)


def _expiring(f):
    """Rules with expiry switched on, in all three last-instance modes."""
    extra = F.when(F.col("owner_user_id") < 8, '"isExpire":1,').when(
        F.col("owner_user_id") < 16, '"isExpire":1,"isLastInstance":true,').otherwise(
        '"isExpire":1,"isLastInstance":false,')
    return f.tasks.withColumn("schedule_conf", F.concat(
        F.lit("{"), extra, F.substr(F.col("schedule_conf"), F.lit(2))))


_EXPIRED = """
j.type = 0 AND t.period_type IN (0, 1) AND j.flow_job_id = '0' AND j.is_restart = 0 AND CASE
WHEN owner_user_id < 8 THEN n < now WHEN owner_user_id < 16 THEN day(n) = day(cyc_ts) AND n < now
WHEN day(n) = day(cyc_ts) THEN n < now ELSE day(n) = 1 END"""


@query("g20_expired", f"""
SELECT id FROM (SELECT j.id, {_EXPIRED} AS e FROM (SELECT *, cyc_ts + INTERVAL 6 HOUR AS n,
TIMESTAMP '1998-07-01 12:00:00' AS now FROM job_runs) j JOIN tasks t ON t.task_id = j.task_id AND t.is_deleted = 0) x
WHERE e
""")
def _(f):
    return readiness.with_rules(f.job_runs, _expiring(f)).where(readiness.expired(NOW)).select("id")


_KEYED = """
SELECT c.job_key, p.job_key AS parent_job_key FROM job_edges e JOIN job_runs c ON c.job_id = e.job_id
JOIN job_runs p ON p.job_id = e.parent_job_id"""

_BUSY = "(4, 15, 1, 2, 3, 11, 14, 16, 17, 19, 20, 23, 25, 10)"

_OWN = f"""
SELECT j.*, CASE WHEN t.task_id IS NULL THEN 9 WHEN j.status <> 0 THEN 7 WHEN cyc_time > '19980701120000' THEN 1
WHEN {_EXPIRED.replace('now', "TIMESTAMP '1998-07-01 12:00:00'")} THEN
  CASE WHEN dependency_type IN (1, 3) AND b.task_id IS NOT NULL THEN 1 ELSE 4 END END AS own
FROM (SELECT *, cyc_ts + INTERVAL 6 HOUR AS n FROM job_runs) j
LEFT JOIN tasks t ON t.task_id = j.task_id AND t.is_deleted = 0
LEFT JOIN (SELECT DISTINCT task_id FROM job_runs WHERE type = 0 AND status IN {_BUSY}
  AND cyc_time >= '19980701000000') b ON b.task_id = j.task_id
"""

_OUTCOME = """
CASE WHEN p.status IS NULL THEN CASE WHEN c.type = 1 THEN 0 ELSE 10 END
WHEN c.flow_job_id <> '0' AND p.task_type = 10 AND p.status = 4 THEN 0
WHEN p.task_id = c.task_id AND c.dependency_type IN (3, 4) THEN
  CASE WHEN p.status IN (5, 7, 8, 9, 12, 13, 18, 21, 24, 26) THEN 0 ELSE 2 END
WHEN p.status IN (8, 9, 21) THEN CASE WHEN p.task_id = c.task_id THEN 8 ELSE 3 END
WHEN p.status = 18 THEN CASE WHEN p.task_id = c.task_id THEN 0 ELSE 12 END
WHEN p.status IN (7, 13, 26) THEN 11 WHEN p.status = 24 THEN 14 WHEN p.status NOT IN (5, 12) THEN 2 ELSE 0 END"""

_WORST = "CASE min(r) WHEN 102 THEN 0 WHEN 101 THEN 2 ELSE min(r) END"


def keyed(f):
    """Instance edges by key. They are a stored table in real life, so they are written once here."""
    runs = f.job_runs
    edges = f.job_edges.join(runs.select("job_id", "job_key"), "job_id").join(
        runs.select(F.col("job_id").alias("parent_job_id"), F.col("job_key").alias("parent_job_key")),
        "parent_job_id").select("job_key", "parent_job_key")
    return materialise(edges, "keyed")[0]


@query("g18_edge_outcomes", f"""
WITH c AS (SELECT * FROM job_runs)
SELECT e.job_key, {_OUTCOME} AS outcome FROM ({_KEYED}) e JOIN c ON c.job_key = e.job_key
LEFT JOIN job_runs p ON p.job_key = e.parent_job_key AND p.type = c.type
""")
def _(f):
    return readiness.edge_outcomes(f.job_runs, keyed(f), f.job_runs)


# A child's previous period by rule never falls on one of the fixture's arbitrary cycle times, so here the
# walk back to the nearest earlier period with children decides; the direct path has its own test.
_CHILD = f"""
SELECT job_key, {_WORST} AS outcome FROM (SELECT m.job_key, CASE
WHEN m.dependency_type = 2 THEN CASE WHEN c.status IN (5, 12) THEN 102
  WHEN c.status IN (7, 8, 9, 13, 18, 21, 24, 26) THEN 15 ELSE 13 END
WHEN c.status IN (5, 7, 8, 9, 12, 13, 18, 21, 24, 26) THEN 102 ELSE 13 END AS r
FROM (SELECT m.job_key, m.dependency_type, max_by(b.job_key, (b.cyc_ts, b.id)) AS back FROM {{pending}} m
  JOIN job_runs b ON b.task_id = m.task_id AND b.type = m.type AND (b.cyc_ts, b.id) < (m.cyc_ts, m.id)
  WHERE m.dependency_type IN (2, 4) AND b.job_key IN (SELECT parent_job_key FROM ({_KEYED}) e) GROUP BY ALL) m
JOIN ({_KEYED}) e ON e.parent_job_key = m.back JOIN job_runs c ON c.job_key = e.job_key
WHERE c.job_key <> m.job_key) x GROUP BY job_key"""


@query("g19_child_period_check", _CHILD.format(pending="job_runs"))
def _(f):
    return readiness.child_period_check(f.job_runs, f.job_runs, keyed(f), f.tasks)


@query("g17_readiness", f"""
WITH o AS ({_OWN}), edge AS (SELECT job_key, {_WORST} AS o FROM (SELECT e.job_key,
  CASE x WHEN 0 THEN 102 WHEN 2 THEN 101 ELSE x END AS r FROM (SELECT e.job_key, {_OUTCOME} AS x
  FROM (SELECT * FROM o WHERE own IS NULL) c JOIN ({_KEYED}) e ON c.job_key = e.job_key
  LEFT JOIN job_runs p ON p.job_key = e.parent_job_key AND p.type = c.type) e) y GROUP BY job_key),
child AS ({_CHILD.format(pending='(SELECT * FROM o WHERE own IS NULL)')})
SELECT o.job_key, CAST(coalesce(own, nullif(edge.o, 0), child.outcome, 0) AS INTEGER) AS outcome
FROM o LEFT JOIN edge ON edge.job_key = o.job_key LEFT JOIN child ON child.job_key = o.job_key
""")
def _(f):
    return readiness.readiness(f.job_runs, keyed(f), _expiring(f), NOW)

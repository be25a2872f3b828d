"""Feeds (J) and governance reports (L)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from opsframe.operators import reports
from opsframe.plans.storage import scratch_dir
from opsframe.streaming import feeds
from opsframe.suite import query


def _events_stream(f):
    schema = ", ".join(f"{n} {t}" for n, t in f.events.dtypes)
    return f._spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f._folder)


def _reports(events):
    status = F.when(F.col("event_type") == "error", 15).otherwise(F.col("event_id") % 15)
    return events.select(
        "event_id", F.col("user_id").alias("job_id"), status.cast("int").alias("status"),
        (F.col("user_id") % 2).cast("int").alias("compute_type"), "ts")


def _store(f, stream, mode="append", sink=None):
    base = f"{scratch_dir(f._spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    feeds.run_to_files(stream, f"{base}/out", f"{base}/state", mode, sink(f"{base}/out") if sink else None)
    return f"{base}/out"


#: Rows of a delivered file at most. A stream cuts its tasks by bytes, and a few megabytes of events can be a minute's work.
FILE_ROWS = 50_000


def _fed(f, make, mode="append", sink=None, timers=False, parts=3):
    """Feeds ``make(events stream)`` the events in ``parts`` deliveries by time, with a restart after each; returns the sink's folder."""
    spark = f._spark
    base = f"{scratch_dir(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = f.events.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)], 10_000)).first()[0]
    share = sum((F.when(at > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for k in range(parts):
        f.events.where(share == k).write.mode("append").option("maxRecordsPerFile", FILE_ROWS).parquet(f"{base}/in")
        stream = make(spark.readStream.schema(f.events.schema).parquet(f"{base}/in"))
        feeds.run_to_files(stream, f"{base}/out", f"{base}/state", mode, sink(f"{base}/out") if sink else None, timers)
    return f"{base}/out"


# An ordered fold, one report after the other.
_FOLD = """
WITH RECURSIVE r AS (SELECT job_id, compute_type, status, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n
  FROM status_feed),
w(job_id, compute_type, n, status) AS (SELECT job_id, compute_type, n, CAST(status AS BIGINT) FROM r WHERE n = 1 UNION ALL
  SELECT r.job_id, r.compute_type, r.n, CAST(CASE WHEN r.compute_type = 0 AND w.status = 6
    AND r.status NOT IN (7, 13, 24, 26) THEN 6 ELSE r.status END AS BIGINT)
  FROM w JOIN r ON r.job_id = w.job_id AND r.n = w.n + 1)
SELECT job_id, CAST(arg_max(status, n) AS INTEGER) AS status FROM w GROUP BY job_id
"""


@query("j01_current_status", _FOLD)
def _(f):
    return feeds.current_status(f.status_feed)


@query("j01_current_status_stream", _FOLD)
def _(f):
    path = _fed(f, lambda events: feeds.current_status(_reports(events)), "update")
    return feeds.read_latest(f._spark, path, ["job_id"]).select("job_id", "status")


def _debounced(n: int, span: int) -> str:
    return f"""
SELECT event_id, CAST(CASE WHEN status = 15 AND (row_number() OVER (PARTITION BY job_id, island ORDER BY ts, event_id) >= {n}
  OR epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY job_id, island) >= {span} * 1000000::BIGINT) THEN 8 ELSE status END
  AS INTEGER) AS status
FROM (SELECT *, CASE WHEN status = 15 THEN sum(CASE WHEN status <> 15 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id
  ORDER BY ts, event_id) ELSE -event_id - 1 END AS island FROM status_feed) s"""


@query("j02_debounce_not_found", _debounced(3, 36_000))
def _(f):
    return feeds.debounce_not_found(f.status_feed, 3, 36_000).select("event_id", "status")


@query("j02_debounce_stream", _debounced(3, 36_000))
def _(f):
    path = _fed(f, _reports, sink=lambda p: feeds.debounce_sink(p, 3, 36_000))
    return f._spark.read.parquet(f"{path}/rows").select("event_id", "status")


def _histories(events):
    """One JSON document per event: its own checkpoint and the one before, as an engine reports them."""
    def entry(i):
        return F.struct(
            i.alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("trigger_timestamp"),
            F.when(i % 7 == 0, feeds.NO_PATH).otherwise(F.concat(F.lit("hdfs://cp/"), i.cast("string"))).alias(
                "external_path"),
            F.when(i % 5 == 0, "FAILED").otherwise("COMPLETED").alias("status"))

    doc = F.to_json(F.struct(F.array(entry(F.col("event_id")), entry(F.col("event_id") + 1)).alias("history"),
                             F.lit("c").alias("counts")))
    return events.select(F.col("user_id").alias("task_id"),
                         F.concat(F.lit("e"), (F.col("user_id") % 10).cast("string")).alias("task_engine_id"),
                         doc.alias("doc"))


_DONE = """
SELECT DISTINCT concat('e', user_id % 10) AS task_engine_id, i AS checkpoint_id, concat('hdfs://cp/', i) AS checkpoint_savepath
FROM (SELECT user_id, event_id AS i FROM events UNION ALL SELECT user_id, event_id + 1 FROM events) x
WHERE i % 7 <> 0 AND i % 5 <> 0"""


@query("j03_checkpoint_rows", _DONE)
def _(f):
    return feeds.checkpoint_rows(_histories(f.events)).select("task_engine_id", "checkpoint_id", "checkpoint_savepath")


@query("j03_checkpoint_rows_stream", _DONE)
def _(f):
    path = _store(f, feeds.checkpoint_rows(_histories(_events_stream(f)), delay="60 days"))
    return f._spark.read.parquet(path).select("task_engine_id", "checkpoint_id", "checkpoint_savepath")


@query("j04_rolling_retention", f"""
SELECT task_engine_id, checkpoint_id FROM ({_DONE}) d
QUALIFY row_number() OVER (PARTITION BY task_engine_id ORDER BY checkpoint_id DESC) <= 20
""")
def _(f):
    path = _fed(f, lambda events: feeds.checkpoint_rows(_histories(events), delay="60 days"), sink=lambda p: feeds.retention_sink(p, 20))
    return feeds.read_retained(f._spark, path).select("task_engine_id", "checkpoint_id")


@query("j04_clean_stopped", """
SELECT id, CASE WHEN task_id IN (SELECT job_id FROM status_feed GROUP BY job_id
  HAVING arg_max(status, (ts, event_id)) IN (5, 7, 8, 9, 12, 13, 18, 21, 24, 26)) THEN 1 ELSE is_deleted END AS is_deleted
FROM checkpoints
""")
def _(f):
    last = f.status_feed.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("s"))
    stopped = last.select(F.concat(F.lit("e"), F.col("job_id").cast("string")).alias("task_engine_id"),
                          F.col("s").isin(5, 7, 8, 9, 12, 13, 18, 21, 24, 26).alias("clean"))
    return feeds.clean_stopped(f.checkpoints, stopped).select("id", "is_deleted")


@query("j05_silent_jobs", """
SELECT job_id, ts AS since, 8 AS status FROM (SELECT *, coalesce(lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id),
TIMESTAMP '2024-02-01 00:00:00') AS nxt FROM status_feed) s
WHERE epoch_us(nxt) - epoch_us(ts) >= 43200 * 1000000::BIGINT AND status NOT IN (5, 7, 8, 9, 12, 13, 18, 21, 24, 26)
""")
def _(f):
    return feeds.silent_jobs(f.status_feed, 43_200, dt.datetime(2024, 2, 1))


@query("j05_silent_jobs_stream", """
WITH m AS (SELECT (epoch_ms(max(ts)) - 3600000) * 1000 AS mark FROM status_feed),
n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS nxt FROM status_feed)
SELECT job_id, ts AS since, 8 AS status FROM n, m WHERE epoch_us(ts) <= mark
AND least(coalesce(epoch_us(nxt), mark), mark) - epoch_us(ts) >= 43200 * 1000000::BIGINT AND status NOT IN (5, 7, 8, 9, 12, 13, 18, 21, 24, 26)
""")
def _(f):
    path = _fed(f, lambda events: feeds.silent_jobs_stream(_reports(events), 43_200, "1 hour"), timers=True)
    return f._spark.read.parquet(path).select("job_id", F.col("since").cast("timestamp_ntz").alias("since"), "status")


_ALERTS = """
SELECT a.alarm_id, c.channel_id, c.gate_type, coalesce(r.user_id, -1) AS user_id,
concat('job ', a.job_id, ' on channel, value ', CAST(floor(value) AS BIGINT)) AS content
FROM alarms a JOIN channels c USING (channel_group)
LEFT JOIN receivers r ON r.channel_group = a.channel_group AND c.gate_type <> 3
WHERE c.gate_type IN (3, 4) OR r.user_id IS NOT NULL
"""


def _alerts(f, alarms, keep=(), size=None):
    out = feeds.build_alerts(
        alarms, f.channels, f.receivers, "job ${job} on channel, value ${v}",
        {"job": F.col("job_id"), "v": F.floor("value").cast("string")}, keep, size)
    return out.select("alarm_id", "channel_id", "gate_type", "user_id", "content", *keep)


@query("j06_build_alerts", _ALERTS)
def _(f):
    return _alerts(f, f.alarms, size=f.alarms.count())


@query("j06_build_alerts_stream", _ALERTS)
def _(f):
    alarms = _events_stream(f).where("event_type = 'error'").select(
        F.col("event_id").alias("alarm_id"), F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"),
        (F.col("event_id") % 5).alias("channel_group"), "value", "ts")
    out = _store(f, alarms, sink=lambda path: feeds.record_sink(path, lambda batch: _alerts(f, batch, size=batch.count())))
    return f._spark.read.parquet(out).drop("batch")


@query("c15_channel_fan_out", """
SELECT c.channel_id, count(*) AS n FROM alarms a JOIN channels c USING (channel_group)
LEFT JOIN receivers r ON r.channel_group = a.channel_group AND c.gate_type <> 3
WHERE c.gate_type IN (3, 4) OR r.user_id IS NOT NULL GROUP BY c.channel_id
""")
def _(f):
    # alarms of a group go to the same channels and receivers: one of each group is sent, and counts for all of them
    groups = f.alarms.groupBy("channel_group").agg(
        F.min_by(F.struct("alarm_id", "job_id", "value"), "alarm_id").alias("a"), F.count(F.lit(1)).alias("alarms"))
    return _alerts(f, groups.select("channel_group", "a.*", "alarms"), ["alarms"]).groupBy("channel_id").agg(F.sum("alarms").alias("n"))


@query("j08_overdue", """
SELECT job_id, 26 AS status FROM queue WHERE epoch(TIMESTAMP '2001-09-01') - epoch(gmt_create) >
CASE WHEN stage = 2 THEN 86400 * 400 ELSE 86400 * 1000 END
""")
def _(f):
    queue = f.queue.withColumn("wait_limit", F.when(F.col("stage") == 2, 86_400 * 400))
    return feeds.overdue(queue, dt.datetime(2001, 9, 1), 86_400 * 1000, "wait_limit").select("job_id", "status")


_TUMBLE = """
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS s, event_type, count(*) AS cnt FROM events GROUP BY 1, 2
"""


@query("j09_live_profile", f"""
SELECT 'tumbling' AS kind, strftime(s, '%Y-%m-%d %H') AS start, event_type, cnt FROM ({_TUMBLE}) t
UNION ALL
SELECT 'sliding', strftime(w, '%Y-%m-%d %H'), event_type, count(*) FROM (
  SELECT unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01'),
  time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 3 HOUR]) AS w, event_type FROM events) x GROUP BY ALL
UNION ALL
SELECT 'session', strftime(min(ts), '%Y-%m-%d %H'), event_type, count(*) FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END)
  OVER (PARTITION BY event_type ORDER BY ts, event_id) AS sid FROM (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts)
  OVER (PARTITION BY event_type ORDER BY ts, event_id)) >= 7200 * 1000000::BIGINT, true) AS gap FROM events) g) z GROUP BY event_type, sid
""")
def _(f):
    start = F.date_format("start", "yyyy-MM-dd HH").alias("start")
    out = None
    for kind, args in [("tumbling", {"size": "6 hours"}), ("sliding", {"size": "6 hours", "slide": "3 hours"}),
                       ("session", {"size": "", "gap": "2 hours"})]:
        one = feeds.live_profile(f.events, by=("event_type",), **args).select(
            F.lit(kind).alias("kind"), start, "event_type", "cnt")
        out = one if out is None else out.unionByName(one)
    return out


@query("j09_live_profile_stream", f"SELECT strftime(s, '%Y-%m-%d %H') AS start, event_type, cnt FROM ({_TUMBLE}) t")
def _(f):
    path = _fed(f, lambda events: feeds.live_profile(events, "6 hours", by=("event_type",)), "update")
    return feeds.read_latest(f._spark, path, ["start", "end", "event_type"]).select(
        F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "cnt")


# --- L -------------------------------------------------------------------------------------------

@query("l01_over_limit", """
SELECT task_id, concat('driverMemory: ', task_id % 4 + 1, 'g (限制: 2048)') AS messages FROM tasks
JOIN limits USING (project_id) WHERE task_id % 4 + 1 > 2
UNION ALL SELECT task_id, concat('driverMemory: ', task_id % 4 + 1, 'g (限制: 2048)') FROM tasks JOIN limits USING (project_id)
WHERE FALSE
""")
def _(f):
    limits = f.limits.withColumn("resource_limit", F.concat(
        F.lit('{"driver.memory": '), F.col("driver_memory_mb").cast("string"), F.lit(', "driver.cores": 4}')))
    out = reports.over_limit(f.tasks, limits)
    return out.select("task_id", F.array_join("messages", "; ").alias("messages"))


@query("l01_over_limit_by_type", """
WITH t AS (SELECT c_custkey AS task_id, c_custkey % 7 AS project_id, c_custkey % 9 AS task_type, c_custkey % 4 + 1 AS g, c_nationkey AS n FROM customer)
SELECT task_id, concat('driverMemory: ', g, 'g (限制: 2048)') AS messages FROM t WHERE task_type IN (0, 1, 3) AND g > 2 AND project_id <> 3
UNION ALL SELECT task_id, concat('jobManagerMemory: ', g * 1000, ' (限制: 2048)') FROM t WHERE task_type = 2 AND g > 2 AND project_id <> 3
UNION ALL SELECT task_id, concat_ws('; ', CASE WHEN g > 2 THEN concat('workerMemory: ', g, 'G (限制: 2048)') END,
  CASE WHEN n > 4 THEN concat('workerCores: ', n, ' (限制: 4)') END) FROM t WHERE task_type IN (6, 7) AND project_id <> 3 AND (g > 2 OR n > 4)
""")
def _(f):
    key, size = F.col("c_custkey"), (F.col("c_custkey") % 4 + 1)
    lines = F.concat(
        F.lit("driver.memory="), size, F.lit("g\njobmanager.memory.mb="), size * 1000, F.lit("\nworker.memory="), size, F.lit("G\nworker.cores="),
        F.col("c_nationkey"))
    tasks = f.customer.select(key.alias("task_id"), (key % 7).alias("project_id"), (key % 9).alias("task_type"), lines.alias("task_params"))
    limits = tasks.where("project_id <> 3").select("project_id", "task_type").distinct().withColumn("resource_limit", F.lit(
        '{"driver.memory": 2048, "jobmanager.memory.mb": 2048, "worker.memory": 2048, "worker.cores": 4}'))
    out = reports.over_limit(tasks, limits, ["project_id", "task_type"], None)
    return out.select("task_id", F.array_join("messages", "; ").alias("messages"))


@query("l02_audit_page", """
SELECT id, operation, CASE operation WHEN 'view' THEN 'opened' WHEN 'error' THEN 'failed' ELSE operation END AS operation_text
FROM audit WHERE tenant_id = 3 ORDER BY gmt_create DESC, id LIMIT 50
""")
def _(f):
    return reports.audit_page(f.audit, {"view": "opened", "error": "failed"}, size=50, tenant_id=3).select(
        "id", "operation", "operation_text")


def _alert_records(f):
    return f.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("user_id"), (F.col("event_id") % 2).alias("read_status"),
        (F.col("event_id") % 3).alias("alert_record_status"), F.lit(0).alias("is_deleted"), F.col("ts").alias("gmt_created"))


@query("l03_alert_page", """
SELECT event_id AS id FROM events WHERE event_id % 2 = 0 ORDER BY event_id DESC LIMIT 40 OFFSET 40
""")
def _(f):
    return reports.alert_page(_alert_records(f), 2, 40, read_status=0).select("id")


@query("l03_unread", "SELECT event_id AS id, user_id FROM events WHERE event_id % 2 = 0")
def _(f):
    return reports.unread(_alert_records(f)).select("id", "user_id")


@query("l04_pending_alerts", """
WITH p AS (SELECT event_id FROM events WHERE event_id % 3 IN (0, 1) AND ts BETWEEN TIMESTAMP '2024-01-05' AND
TIMESTAMP '2024-01-25')
SELECT 'count' AS kind, count(*) AS v FROM p UNION ALL SELECT 'row', event_id FROM (SELECT * FROM p ORDER BY event_id LIMIT 500) q
""")
def _(f):
    count, rows = reports.pending_alerts(_alert_records(f), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25), [0, 1])
    return count.select(F.lit("count").alias("kind"), F.col("cnt").alias("v")).unionByName(
        rows.select(F.lit("row").alias("kind"), F.col("id").alias("v")))


@query("l05_register_sources", """
WITH b AS (SELECT s_suppkey AS id, s_name AS source_name, 1 AS source_type, concat('jdbc:mysql://h', s_nationkey, ':3306/a') AS url,
  concat('h', s_nationkey, '#3306') AS source_key FROM supplier WHERE s_acctbal > 0),
n AS (SELECT s_suppkey AS id, concat(s_name, '!') AS source_name, CASE WHEN s_nationkey = 5 THEN 1000 ELSE 1 END AS source_type,
  concat('jdbc:mysql://h', CASE WHEN s_nationkey < 3 THEN 99 ELSE s_nationkey END, ':3306/b') AS url,
  CASE WHEN s_nationkey = 5 THEN concat('custom_', s_name, '!') WHEN s_nationkey < 3 THEN 'h99#3306'
  ELSE concat('h', s_nationkey, '#3306') END AS source_key FROM supplier),
x AS (SELECT n.*, b.source_key AS old FROM n LEFT JOIN b USING (id))
SELECT 'rejected' AS kind, id, source_name, source_key FROM x WHERE old IS NOT NULL AND old <> source_key
UNION ALL SELECT 'stored', coalesce(g.id, b.id), coalesce(g.source_name, b.source_name), coalesce(b.source_key, g.source_key)
FROM b FULL JOIN (SELECT * FROM x WHERE old IS NULL OR old = source_key) g ON g.id = b.id
""")
def _(f):
    host = F.col("s_nationkey").cast("string")

    def url(h, db):
        return F.concat(F.lit("jdbc:mysql://h"), h, F.lit(f":3306/{db}"))

    base = f.supplier.where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("source_name"), F.lit(1).alias("source_type"),
        url(host, "a").alias("url"), F.concat(F.lit("h"), host, F.lit("#3306")).alias("source_key"))
    new = f.supplier.select(
        F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit("!")).alias("source_name"),
        F.when(F.col("s_nationkey") == 5, 1000).otherwise(1).alias("source_type"),
        url(F.when(F.col("s_nationkey") < 3, "99").otherwise(host), "b").alias("url"))
    stored, rejected = reports.register_sources(base, new)
    return stored.select(F.lit("stored").alias("kind"), "id", "source_name", "source_key").unionByName(
        rejected.select(F.lit("rejected").alias("kind"), "id", "source_name", "source_key"))

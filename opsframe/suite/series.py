"""Time series (K, D25-D30, E17, J7)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsframe.operators import series
from opsframe.suite import query

START, END = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 10)
HOUR6 = 6 * 3_600_000

# One series per (event type, user bucket): thousands of samples each.
_SERIES = "(SELECT event_type AS metric, user_id % 10 AS job_id, event_id % 4 AS subtask_index, ts, value FROM events)"


def samples(f):
    rows = f.events.select(
        F.col("event_type").alias("metric"), (F.col("user_id") % 10).alias("job_id"),
        (F.col("event_id") % 4).alias("subtask_index"), "ts", "value")
    return series.samples_from(rows, ["job_id", "subtask_index"])


def flat(df, *labels):
    cols = [F.try_element_at("labels", F.lit(name)).alias(name) for name in labels]
    return df.select(*cols, "ts", F.round("value", 6).alias("value"))


def grid(metric: str = "purchase", lookback: str = "6 HOUR", step: str = "1 HOUR", where: str = "TRUE") -> str:
    """Latest sample within the look-back at each grid point, by an as-of join."""
    return f"""
SELECT g.job_id, g.subtask_index, epoch_ms(g.t) AS ts, s.value FROM (
  SELECT * FROM (SELECT DISTINCT job_id, subtask_index FROM {_SERIES} x WHERE metric = '{metric}' AND {where}) k,
  (SELECT unnest(range(TIMESTAMP '{START}', TIMESTAMP '{END}' + INTERVAL 1 SECOND, INTERVAL {step})) AS t) p) g
ASOF JOIN (SELECT job_id, subtask_index, epoch_ms(ts) AS ms, date_trunc('milliseconds', ts) AS at, max_by(value, ts) AS value
  FROM {_SERIES} x WHERE metric = '{metric}' AND {where} GROUP BY ALL) s
ON s.job_id = g.job_id AND s.subtask_index = g.subtask_index AND s.at <= g.t
WHERE s.at >= g.t - INTERVAL {lookback}"""


def ranged(f, metric="purchase", filters=()):
    return series.query_range(samples(f), metric, START, END, "1h", filters, lookback=HOUR6)


@query("k01_query_range", f"""
SELECT CAST(job_id AS VARCHAR) AS job_id, CAST(subtask_index AS VARCHAR) AS subtask_index, ts, round(value, 6) AS value
FROM ({grid()}) q
""")
def _(f):
    return flat(ranged(f), "job_id", "subtask_index")


@query("k02_query_instant", f"""
SELECT CAST(job_id AS VARCHAR) AS job_id, CAST(subtask_index AS VARCHAR) AS subtask_index,
epoch_ms(TIMESTAMP '2024-01-10') AS ts, round(max_by(value, ts), 6) AS value FROM {_SERIES} x
WHERE metric = 'view' AND date_trunc('milliseconds', ts) BETWEEN TIMESTAMP '2024-01-09' AND TIMESTAMP '2024-01-10'
GROUP BY 1, 2
""")
def _(f):
    return flat(series.query_instant(samples(f), "view", END, lookback=86_400_000), "job_id", "subtask_index")


@query("k03_to_series", f"""
SELECT CAST(job_id AS VARCHAR) AS tag, string_agg(concat(ts, '=', CAST(value AS INTEGER)), ',' ORDER BY ts) AS dps FROM (
SELECT job_id, ts, floor(sum(value)) AS value FROM ({grid()}) q GROUP BY ALL) z GROUP BY job_id
""")
def _(f):
    total = series.agg_series(ranged(f), "sum", by=["job_id"])
    out = series.to_series(total, "job_id")
    text = F.transform("dps", lambda p: F.concat(p["ts"].cast("string"), F.lit("="),
                                                 F.floor(p["value"]).cast("string")))
    return out.select("tag", F.array_join(text, ",").alias("dps"))


@query("k04_series_query", f"""
SELECT ts, round(max(v), 6) AS value FROM (SELECT ts, job_id, sum(value) AS v
FROM ({grid(where="job_id <> 3 AND subtask_index IN (1, 2)")}) q GROUP BY ALL) z GROUP BY ts
""")
def _(f):
    q = series.SeriesQuery("purchase", [("job_id", "!=", "3"), ("subtask_index", "=~", "1|2")], step="1h",
                           lookback=HOUR6).then("sum", by=["job_id"]).then("max")
    return flat(q.range(samples(f), START, END))


@query("d25_agg_series", f"""
SELECT ts, round(sum(value), 6) AS s, round(min(value), 6) AS mi, round(max(value), 6) AS ma, round(avg(value), 6) AS av,
round(stddev_pop(value), 6) AS sd, round(var_pop(value), 6) AS sv, CAST(count(*) AS DOUBLE) AS n
FROM ({grid()}) q GROUP BY ts
""")
def _(f):
    rows, out = ranged(f), None
    for fn, name in [("sum", "s"), ("min", "mi"), ("max", "ma"), ("avg", "av"), ("stddev", "sd"), ("stdvar", "sv"),
                     ("count", "n")]:
        one = series.agg_series(rows, fn).select("ts", F.round("value", 6).alias(name))
        out = one if out is None else out.join(one, "ts")
    return out


@query("d26_count_values", f"""
SELECT regexp_replace(CAST(floor(value / 10) AS VARCHAR), '[.]0$', '') AS v, ts, CAST(count(*) AS DOUBLE) AS value
FROM ({grid()}) q GROUP BY 1, 2
""")
def _(f):
    rows = ranged(f).withColumn("value", F.floor(F.col("value") / 10).cast("double"))
    return flat(series.agg_series(rows, "count_values", "v"), "v")


@query("d27_quantile", f"""
SELECT CAST(subtask_index AS VARCHAR) AS subtask_index, ts, round(quantile_cont(value, 0.9), 6) AS value
FROM ({grid()}) q GROUP BY 1, 2
""")
def _(f):
    return flat(series.agg_series(ranged(f), "quantile", 0.9, by=["subtask_index"]), "subtask_index")


@query("d28_by_without", f"""
SELECT 'by' AS kind, CAST(job_id AS VARCHAR) AS job_id, ts, round(sum(value), 6) AS value FROM ({grid()}) q GROUP BY 2, 3
UNION ALL
SELECT 'without', CAST(job_id AS VARCHAR), ts, round(avg(value), 6) FROM ({grid()}) q GROUP BY 2, 3
""")
def _(f):
    rows = ranged(f)
    a = flat(series.agg_series(rows, "sum", by=["job_id"]), "job_id").withColumn("kind", F.lit("by"))
    b = flat(series.agg_series(rows, "avg", without=["subtask_index"]), "job_id").withColumn("kind", F.lit("without"))
    return a.unionByName(b)


@query("d29_pipeline", f"""
SELECT ts, round(avg(v), 6) AS value FROM (SELECT ts, subtask_index, max(value) AS v FROM ({grid()}) q GROUP BY ALL) z
GROUP BY ts
""")
def _(f):
    return flat(series.pipeline(ranged(f), [
        lambda d: series.agg_series(d, "max", by=["subtask_index"]), lambda d: series.agg_series(d, "avg")]))


@query("e17_topk", f"""
SELECT 'topk' AS kind, CAST(job_id AS VARCHAR) AS job_id, CAST(subtask_index AS VARCHAR) AS subtask_index, ts,
round(value, 6) AS value FROM ({grid()}) q
QUALIFY row_number() OVER (PARTITION BY ts ORDER BY value DESC, job_id, subtask_index) <= 3
UNION ALL
SELECT 'bottomk', CAST(job_id AS VARCHAR), CAST(subtask_index AS VARCHAR), ts, round(value, 6) FROM ({grid()}) q
QUALIFY row_number() OVER (PARTITION BY ts, subtask_index ORDER BY value, job_id) <= 2
""")
def _(f):
    rows = ranged(f)
    a = flat(series.agg_series(rows, "topk", 3), "job_id", "subtask_index").withColumn("kind", F.lit("topk"))
    b = flat(series.agg_series(rows, "bottomk", 2, by=["subtask_index"]), "job_id", "subtask_index")
    return a.unionByName(b.withColumn("kind", F.lit("bottomk")))


_PAIRS = f"""
SELECT job_id, subtask_index, epoch_ms(ts) AS ms, value, lag(epoch_ms(ts)) OVER w AS pms, lag(value) OVER w AS pv
FROM {_SERIES} x WHERE metric = 'click' WINDOW w AS (PARTITION BY job_id, subtask_index ORDER BY ts)"""


@query("j07_irate", f"""
SELECT CAST(job_id AS VARCHAR) AS job_id, CAST(subtask_index AS VARCHAR) AS subtask_index,
epoch_ms(TIMESTAMP '2024-01-10') AS ts,
round(CASE WHEN value < pv THEN value ELSE value - pv END / ((ms - pms) / 1000.0), 6) AS value
FROM (SELECT * FROM ({_PAIRS}) p WHERE ms <= epoch_ms(TIMESTAMP '2024-01-10') AND ms > epoch_ms(TIMESTAMP '2024-01-08')
QUALIFY row_number() OVER (PARTITION BY job_id, subtask_index ORDER BY ms DESC) = 1) z
WHERE pms > epoch_ms(TIMESTAMP '2024-01-08')
""")
def _(f):
    rows = series.select_series(samples(f), "click")
    return flat(series.irate(rows, END, 2 * 86_400_000), "job_id", "subtask_index")


@query("j07_irate_range", f"""
SELECT CAST(g.job_id AS VARCHAR) AS job_id, CAST(g.subtask_index AS VARCHAR) AS subtask_index, g.t AS ts,
round(CASE WHEN value < pv THEN value ELSE value - pv END / ((ms - pms) / 1000.0), 6) AS value FROM (
  SELECT * FROM (SELECT DISTINCT job_id, subtask_index FROM {_SERIES} x WHERE metric = 'click') k,
  (SELECT epoch_ms(unnest(range(TIMESTAMP '{START}', TIMESTAMP '{END}' + INTERVAL 1 SECOND, INTERVAL 3 HOUR))) AS t) p) g
ASOF JOIN ({_PAIRS}) s ON s.job_id = g.job_id AND s.subtask_index = g.subtask_index AND s.ms <= g.t
WHERE pms > g.t - 86400000
""")
def _(f):
    return flat(series.irate_range(samples(f), "click", START, END, "3h", 86_400_000), "job_id", "subtask_index")


# Sync metrics: five of the metric names stand for the five event types.
_NAMES = {"click": "numRead", "view": "numWrite", "error": "nErrors", "purchase": "conversionErrors",
          "signup": "endLocation"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " END"


def _named(f):
    name = F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv])
    rows = f.events.select(
        name[F.col("event_type")].alias("metric"), F.col("user_id").alias("job_id"),
        (F.col("event_id") % 4).alias("subtask_index"), "ts", "value")
    return series.samples_from(rows, ["job_id", "subtask_index"])


_LATEST = f"""
SELECT {_CASE} AS metric, CAST(user_id AS VARCHAR) AS job_id, event_id % 4 AS sub, max(epoch_ms(ts)) AS ms,
max_by(value, ts) AS v FROM events WHERE epoch_ms(ts) BETWEEN epoch_ms(TIMESTAMP '2024-01-03') - 86400000
AND epoch_ms(TIMESTAMP '2024-01-10') GROUP BY ALL"""


@query("d30_sync_metric", f"""
WITH l AS ({_LATEST}), t AS (SELECT job_id, least(epoch_ms(TIMESTAMP '2024-01-10'), epoch_ms(TIMESTAMP '2024-01-03') +
  (max(ms) + 86400000 - epoch_ms(TIMESTAMP '2024-01-03')) // 3000 * 3000) AS t FROM l
  WHERE metric = 'conversionErrors' GROUP BY job_id)
SELECT 'subtasks' AS form, job_id, CAST(sum(CAST(trunc(greatest(v, 0)) AS BIGINT)) AS BIGINT) AS value FROM l
WHERE metric = 'numRead' GROUP BY job_id
UNION ALL SELECT 'total', l.job_id, CAST(trunc(greatest(sum(v), 0)) AS BIGINT) FROM l JOIN t USING (job_id)
WHERE metric = 'conversionErrors' AND ms >= t - 86400000 GROUP BY l.job_id
UNION ALL SELECT 'max', job_id, CAST(trunc(greatest(max(v), 0)) AS BIGINT) FROM l WHERE metric = 'numWrite' GROUP BY job_id
""")
def _(f):
    rows, day = _named(f), 86_400_000
    out = series.sync_metric(rows, "unknownName", START, END).withColumn("form", F.lit("none"))
    for form, name in [("subtasks", "numRead"), ("total", "conversionErrors"), ("max", "numWrite")]:
        one = series.sync_metric(rows, name, START, END, form="max" if form == "max" else None, lookback=day)
        out = out.unionByName(one.withColumn("form", F.lit(form)))
    return out


@query("k05_last_location", """
WITH r AS (SELECT c_custkey AS id, c_custkey AS user_id, TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 1 HOUR *
  c_nationkey AS lo, TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 1 HOUR * c_nationkey AS hi FROM customer)
SELECT id, CAST(sum(CAST(trunc(greatest(v, 0)) AS BIGINT)) AS BIGINT) AS location FROM (
SELECT r.id, event_id % 4 AS sub, max_by(value, ts) AS v FROM r JOIN events e ON e.user_id = r.user_id
WHERE event_type = 'signup' AND epoch_ms(ts) BETWEEN epoch_ms(lo) AND epoch_ms(hi) + 60000 GROUP BY ALL) z
GROUP BY id HAVING sum(CAST(trunc(greatest(v, 0)) AS BIGINT)) <> 0
""")
def _(f):
    hours = F.make_dt_interval(hours=F.col("c_nationkey").cast("int"))
    runs = f.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("job_id"),
        (F.lit(dt.datetime(2024, 1, 5)).cast("timestamp_ntz") + hours).alias("exec_start_time"),
        (F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz") + hours).alias("exec_end_time"))
    return series.last_location(_named(f), runs)

"""Tables of the shapes the operators expect, derived from the generic test tables.

Each text is one SELECT valid in Spark SQL and in DuckDB. ``Fixtures`` gives them as
DataFrames; ``oracle`` prefixes DuckDB SQL with the same texts as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURE_SQL: dict[str, str] = {
    "jobs": """
SELECT o_orderkey AS id, concat('j', o_orderkey) AS job_id, o_custkey AS task_id, o_custkey % 7 AS project_id, 1 AS app_type,
       CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS type, o_orderkey % 27 AS status, o_orderkey % 5 AS period_type,
       o_orderkey % 4 AS retry_num, o_orderkey % 9 AS version_id,
       CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey % 40 + 1 ELSE 0 END AS fill_id,
       CAST(floor(o_totalprice) AS BIGINT) % 7200 AS exec_time,
       o_orderdate + INTERVAL '1' SECOND * (o_orderkey * 37 % 86400) AS cyc_ts,
       CASE WHEN o_orderkey % 6 = 0 THEN 10 ELSE 0 END AS task_type,
       CASE WHEN o_orderkey % 6 IN (1, 2) AND o_orderkey > 6 THEN concat('j', o_orderkey - o_orderkey % 6) ELSE '0' END AS flow_job_id,
       0 AS is_deleted
FROM orders
""",
    "job_edges": """
SELECT job_id, parent_job_id, 0 AS is_deleted FROM (
  SELECT concat('j', o_orderkey) AS job_id,
         concat('j', lag(o_orderkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey)) AS parent_job_id,
         lag(o_orderkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS p
  FROM orders
  UNION ALL
  SELECT concat('j', o_orderkey), concat('j', CAST(floor(o_orderkey / 2) AS BIGINT)), CAST(floor(o_orderkey / 2) AS BIGINT)
  FROM orders WHERE o_orderkey > 1) e
WHERE p IS NOT NULL
""",
    "tasks": """
SELECT c_custkey AS id, c_custkey AS task_id, c_name AS name, c_custkey % 7 AS project_id, c_nationkey AS owner_user_id, 1 AS app_type,
       c_custkey % 5 AS period_type, CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS is_deleted,
       CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 1 END AS submit_status, c_custkey % 9 AS version_id,
       CASE WHEN c_custkey % 6 = 0 THEN 10 ELSE 0 END AS task_type,
       CASE WHEN c_custkey % 6 IN (1, 2) AND c_custkey > 6 THEN c_custkey - c_custkey % 6 ELSE 0 END AS flow_id,
       CASE c_custkey % 5
         WHEN 0 THEN '{"periodType":"0","beginHour":0,"endHour":23,"beginMin":0,"endMin":59,"gapMin":30,"beginDate":"2001-01-01","endDate":"2121-01-01","selfReliance":0}'
         WHEN 1 THEN '{"periodType":"1","beginHour":2,"endHour":23,"beginMin":15,"gapHour":5,"beginDate":"2001-01-01","endDate":"2121-01-01","selfReliance":1}'
         WHEN 2 THEN '{"periodType":"2","hour":1,"min":30,"beginDate":"2001-01-01","endDate":"2121-01-01","selfReliance":false}'
         WHEN 3 THEN '{"periodType":"3","weekDay":"1,3,07","hour":23,"min":0,"beginDate":"2001-01-01","endDate":"2121-01-01","selfReliance":true}'
         ELSE '{"periodType":"4","day":"1,15,31","hour":0,"min":23,"beginDate":"2001-01-01","endDate":"2121-01-01","selfReliance":false}' END AS schedule_conf,
       concat('driver.memory=', c_custkey % 4 + 1, 'g') AS task_params
FROM customer
""",
    "task_edges": """
SELECT DISTINCT task_id, parent_task_id, 1 AS app_type, 0 AS is_deleted FROM (
  SELECT c_custkey AS task_id, CAST(floor(c_custkey / 2) AS BIGINT) AS parent_task_id FROM customer
  UNION ALL
  SELECT c_custkey, CAST(floor(c_custkey / 3) AS BIGINT) FROM customer) e
WHERE parent_task_id >= 1 AND parent_task_id <> task_id
""",
    "lineage_edges": """
SELECT DISTINCT input_table_id, result_table_id FROM (
  SELECT p_partkey AS input_table_id, p_partkey + 1 + p_partkey % 3 AS result_table_id FROM part
  UNION ALL
  SELECT p_partkey, p_partkey - 5 FROM part WHERE p_partkey % 50 = 0) e
WHERE result_table_id >= 1
""",
    # groups of thirty tables, in layers, with ways back
    "layer_edges": """
SELECT DISTINCT input_table_id, result_table_id FROM (
  SELECT p_partkey AS input_table_id, p_partkey + 1 + p_partkey % 3 AS result_table_id FROM part
  UNION ALL
  SELECT p_partkey, p_partkey + 7 FROM part WHERE p_partkey % 4 = 1
  UNION ALL
  SELECT p_partkey, p_partkey - 5 FROM part WHERE p_partkey % 60 = 20) e
WHERE floor(input_table_id / 30) = floor(result_table_id / 30)
""",
    "lineage_refs": """
SELECT p_partkey AS input_table_id, p_partkey + 1 + p_partkey % 3 AS result_table_id, 1 AS app_type,
       concat('batch', p_partkey % 20) AS unique_key, CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END AS is_deleted
FROM part
""",
    "column_edges": """
SELECT p_partkey AS input_table_id, concat('c', p_partkey % 4) AS input_column_name,
       p_partkey + 1 AS result_table_id, concat('c', (p_partkey + 1) % 4) AS result_column_name
FROM part
""",
    "queue": """
SELECT concat('j', o_orderkey) AS job_id, o_orderpriority AS job_resource, o_orderkey % 5 + 1 AS stage, o_orderdate AS gmt_create,
       o_orderkey * 100000 AS job_priority, 0 AS is_deleted
FROM orders WHERE o_orderstatus <> 'F'
""",
    "fills": """
SELECT DISTINCT o_orderkey % 40 + 1 AS id, concat('fill', o_orderkey % 40 + 1) AS job_name FROM orders WHERE o_orderkey % 10 = 0
""",
    "samples": """
SELECT event_type AS metric, user_id AS job_id, event_id % 4 AS subtask_index, ts, value FROM events
""",
    "status_feed": """
SELECT event_id, user_id AS job_id, CASE WHEN event_type = 'error' THEN 15 ELSE event_id % 15 END AS status,
       user_id % 2 AS compute_type, ts
FROM events
""",
    "checkpoints": """
SELECT event_id AS id, user_id AS task_id, concat('e', user_id) AS task_engine_id, event_id AS checkpoint_id, ts AS checkpoint_trigger,
       CASE WHEN event_type = 'error' THEN NULL ELSE concat('hdfs://ns1/cp/', event_id) END AS checkpoint_savepath, 0 AS is_deleted
FROM events
""",
    "logs": """
SELECT conv_id AS job_id, role AS component, turn AS seq, text AS message FROM conversations
""",
    "audit": """
SELECT event_id AS id, user_id % 5 AS tenant_id, concat('u', user_id) AS operator, event_type AS operation,
       props AS operation_object, ts AS gmt_create
FROM events
""",
    "sql_texts": """
SELECT n_nationkey AS script_id,
       CASE WHEN n_nationkey % 2 = 0
            THEN concat('INSERT OVERWRITE TABLE dm.t', n_nationkey, ' SELECT * FROM ods.r', n_regionkey, ' a JOIN t', n_nationkey + 100, ' b ON a.k = b.k')
            ELSE concat('CREATE TABLE t', n_nationkey, ' AS SELECT ''a;b'' AS x FROM ods.r', n_regionkey) END AS sql_text
FROM nation
""",
    "sql_scripts": """
SELECT c_custkey AS script_id, CASE c_custkey % 5
  WHEN 0 THEN concat('FROM ods.a', c_custkey, ' INSERT OVERWRITE TABLE dm.x', c_custkey, ' SELECT k WHERE k > 1 INSERT INTO dm.y', c_custkey, ' SELECT v')
  WHEN 1 THEN concat('MERGE INTO dm.m', c_custkey, ' t USING ods.s', c_custkey, ' s ON t.k = s.k WHEN MATCHED THEN UPDATE SET v = s.v')
  WHEN 2 THEN concat('CREATE OR REPLACE VIEW dm.v', c_custkey, ' AS SELECT ''from x; y'' AS a FROM ods.b', c_custkey, ' JOIN c USING (k)')
  WHEN 3 THEN concat('WITH p AS (WITH q AS (SELECT * FROM ods.d', c_custkey, ') SELECT * FROM q), r AS (SELECT * FROM p JOIN ods.e) INSERT INTO dm.w', c_custkey, ' SELECT * FROM r')
  ELSE concat('MERGE INTO dm.n', c_custkey, ' USING (SELECT * FROM ods.f, ods.g) u ON 1 = 1; CREATE TEMPORARY VIEW z AS SELECT * FROM ods.h') END AS sql_text
FROM customer
""",
    "sync_source": """
SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN 'bad' ELSE CAST(event_id % 1000 AS VARCHAR(20)) END AS amount_text,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_type END AS kind, ts
FROM events
""",
    "alarms": """
SELECT event_id AS alarm_id, concat('j', user_id) AS job_id, event_id % 5 AS channel_group, value, ts FROM events WHERE event_type = 'error'
""",
    "channels": """
SELECT n_nationkey AS channel_id, n_nationkey % 4 + 1 AS gate_type, n_regionkey AS channel_group FROM nation
""",
    "receivers": """
SELECT s_suppkey AS user_id, s_suppkey % 4 AS channel_group, s_name AS user_name FROM supplier
""",
    "limits": """
SELECT DISTINCT c_custkey % 7 AS project_id, 0 AS task_type, 2048 AS driver_memory_mb FROM customer WHERE c_custkey % 7 <> 3
""",
}

# Text columns that need the one engine-specific function, per engine: (Spark, DuckDB).
_STAMP = ("date_format({c}, 'yyyyMMddHHmmss')", "strftime({c}, '%Y%m%d%H%M%S')")
_DASHED = ("date_format({c}, 'yyyy-MM-dd HH:mm:ss')", "strftime({c}, '%Y-%m-%d %H:%M:%S')")

_JOB_RUNS = """
SELECT j.*, {cyc} AS cyc_time, concat('cronTrigger_', task_id, '_', {cyc}) AS job_key,
       {biz} AS business_date, concat('task', task_id, '_', {cyc}) AS job_name,
       id % 5 AS dependency_type, 0 AS is_restart, 1 AS compute_type,
       cyc_ts + INTERVAL '1' MINUTE AS exec_start_time,
       cyc_ts + INTERVAL '1' MINUTE + INTERVAL '1' SECOND * exec_time AS exec_end_time,
       cyc_ts + INTERVAL '2' MINUTE + INTERVAL '1' SECOND * exec_time AS gmt_modified,
       {next} AS next_cyc_time
FROM jobs j
"""

_BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
         "pages", "benchmark", "labels", "conversations"]


def _job_runs(engine: int) -> str:
    return _JOB_RUNS.format(
        cyc=_STAMP[engine].format(c="cyc_ts"), biz=_STAMP[engine].format(c="(cyc_ts - INTERVAL '1' DAY)"),
        next=_DASHED[engine].format(c="(cyc_ts + INTERVAL '6' HOUR)"))


def _texts(engine: int) -> dict[str, str]:
    return {**FIXTURE_SQL, "job_runs": _job_runs(engine)}


def _needs(name: str, texts: dict[str, str], seen: list[str]) -> None:
    """Fixture names ``name`` depends on, parents first."""
    if name in seen:
        return
    for other in texts:
        if other != name and re.search(rf"\b(FROM|JOIN)\s+{other}\b", texts[name]):
            _needs(other, texts, seen)
    seen.append(name)


def oracle(sql: str) -> str:
    """``sql`` for DuckDB with every fixture it mentions put in front as a CTE."""
    texts = _texts(1)
    seen: list[str] = []
    for name in texts:
        if re.search(rf"\b{name}\b", sql):
            _needs(name, texts, seen)
    sql = sql.strip()
    if not seen:
        return sql
    ctes = ",\n".join(f"{n} AS ({texts[n].strip()})" for n in seen)
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{sql[len('WITH RECURSIVE'):].strip()}"
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:].strip()}"
    return f"WITH {ctes}\n{sql}"


class Fixtures:
    """Lazy access to the derived tables of one data folder: ``Fixtures(spark, folder).jobs``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in _BASE:
            return self.base(name)
        texts = _texts(0)
        if name not in texts:
            raise AttributeError(name)
        chain: list[str] = []
        _needs(name, texts, chain)
        mentioned = {b for b in _BASE for n in chain if re.search(rf"\bFROM\s+{b}\b", texts[n])}
        for b in mentioned:
            self.base(b).createOrReplaceTempView(b)
        ctes = ",\n".join(f"{n} AS ({texts[n].strip()})" for n in chain[:-1])
        return self._spark.sql((f"WITH {ctes}\n" if ctes else "") + texts[name].strip())

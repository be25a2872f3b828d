"""Scripts, sync jobs and cubes (A)."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from opsframe.dims import SOURCE_TYPE
from opsframe.functions.text import partition_map
from opsframe.plans.storage import scratch_dir
from opsframe.sources import cube, registry, script, sync
from opsframe.suite import query


def _views(f, *names):
    for n in names:
        f.base(n).createOrReplaceTempView(n)
    return f._spark


def _fresh(spark, name):
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("a01_run_script", """
SELECT o_orderpriority, count(*) AS n, 'a;b' AS tag, 'it''s' AS quoted FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderpriority
""")
def _(f):
    spark = _views(f, "orders", "customer")
    return script.run_script(spark, """
        CREATE OR REPLACE TEMPORARY VIEW building AS SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING';
        ;
        CREATE OR REPLACE TEMPORARY VIEW joined AS SELECT o.* FROM orders o JOIN building b ON b.c_custkey = o.o_custkey;
        SELECT o_orderpriority, count(*) AS n, 'a;b' AS tag, "it's" AS quoted FROM joined GROUP BY o_orderpriority
    """, conf={"spark.sql.ansi.enabled": "true"}).last


@query("a02_script_options", "SELECT '5' AS parts, count(*) AS n FROM nation")
def _(f):
    spark = _views(f, "nation")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    result = script.run_script(spark, """
        CREATE OR REPLACE TEMPORARY VIEW v AS SELECT count(*) AS n FROM nation;
        SET spark.sql.shuffle.partitions
    """, conf={"spark.sql.shuffle.partitions": "5"}, app_name="options")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    return result.last.select(F.col("value").alias("parts")).crossJoin(spark.table("v"))


@query("a03_skip_select", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def _(f):
    spark = _views(f, "nation")
    result = script.run_script(spark, """
        CREATE OR REPLACE TEMPORARY VIEW per_region AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1;
        SELECT * FROM a_table_that_does_not_exist
    """, skip_select=True)
    assert [state for _, _, state in result.report] == ["done", "skipped"]
    return spark.table("per_region")


@query("a04_run_sql_job", """
SELECT o_orderkey, '1234' AS dd, '20240130103000' AS day FROM orders WHERE strftime(o_orderdate, '%Y%m%d') < '19970101'
""")
def _(f):
    spark = _views(f, "orders")
    params = [(0, "bizdate", "yyyyMMdd-1"), (1, "dd", "1234"), (1, "yesterday", "${hh24miss-0/24}")]
    return script.run_sql_job(
        spark, "SELECT o_orderkey, '${dd}' AS dd, '${yesterday}' AS day FROM orders "
        "WHERE date_format(o_orderdate, 'yyyyMMdd') < '19970101' AND '${bizdate}' = '20240130'",
        params, "20240131103000", "20240201000000").last


@query("a05_query", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def _(f):
    spark = _views(f, "supplier")
    return script.query(spark, "SELECT s_suppkey AS `t.s_suppkey`, s_name AS `t.s_name` FROM supplier WHERE s_acctbal > 0",
                        "default")


@query("a07_list_columns", """
SELECT * FROM (VALUES ('n_nationkey', 'int', ''), ('n_name', 'string', ''), ('n_regionkey', 'int', '')) t(name, type, comment)
""")
def _(f):
    return script.list_columns(_views(f, "nation"), "nation")


def _job(f, target, **writer):
    return {"job": {
        "content": [{
            "reader": {"parameter": {
                "column": [{"name": "event_id", "type": "NUMBER"}, {"name": "props", "type": "VARCHAR2"},
                           {"name": "ts", "type": "TIMESTAMP"}, {"name": "value", "type": "NUMBER"}],
                "path": f"{f._folder}/events.parquet", "splitPk": "event_id", "customSql": ""}},
            "writer": {"parameter": {
                "path": target, "fileType": "orc", "writeMode": "overwrite",
                "column": [{"name": "amount", "index": 3, "type": "decimal(10,0)"},
                           {"name": "id", "index": 0, "type": "bigint"}, {"name": "day", "index": 2, "type": "date"}],
                **writer}}}],
        "setting": {"restore": {"isRestore": False}, "errorLimit": {"record": 100, "percentage": 0.0},
                    "speed": {"channel": 2, "bytes": 2097152}}}}


@query("a08_sync", """
SELECT event_id AS id, CAST(floor(value + 0.5) AS BIGINT) AS amount, strftime(ts, '%Y-%m-%d') AS day FROM events
""")
def _(f):
    spark = f._spark
    target = _fresh(spark, "copy")
    seen = sync.sync(spark, _job(f, target))
    assert seen["nErrors"] == 0
    return spark.read.orc(target).select(
        "id", F.col("amount").cast("long").alias("amount"), F.col("day").cast("string").alias("day"))


@query("a15_sync_split_read", """
SELECT event_id AS id, event_type AS kind FROM events
""")
def _(f):
    spark = f._spark
    target = _fresh(spark, "split")
    job = {"content": [{
        "reader": {"path": f"{f._folder}/events.parquet", "splitPk": "event_id",
                   "column": [{"name": "event_id"}, {"name": "event_type"}]},
        "writer": {"path": target, "column": [{"name": "id", "index": 0, "type": "bigint"},
                                              {"name": "kind", "index": 1, "type": "string"}]}}],
        "setting": {"speed": {"channel": 4}}}
    sync.sync(spark, job)
    return spark.read.parquet(target)


@query("a19_source_registry", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _(f):
    spark = _views(f, "nation")
    df = registry.read_source(spark, SOURCE_TYPE["HIVE"], {"table": "nation"})
    return df.where("n_regionkey = 1").select("n_nationkey", "n_name")


@query("a10_sync_text_files", """
SELECT event_id AS id, CAST(floor(value + 0.5) AS BIGINT) AS amount, strftime(ts, '%Y-%m-%d') AS day FROM events
""")
def _(f):
    spark = f._spark
    target = _fresh(spark, "text")
    sync.sync(spark, _job(f, target, fileType="text", fieldDelimiter="|", encoding="UTF-8", writeMode="append"))
    return spark.read.schema("amount long, id long, day string").option("sep", "|").csv(target)


@query("a11_write_partition", """
SELECT 'a/1' AS pt, event_type, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 2
UNION ALL SELECT 'b', event_type, count(*) FROM events WHERE event_type = 'click' GROUP BY 2
""")
def _(f):
    spark = f._spark
    target = _fresh(spark, "parts")
    rows = f.events.select("event_id", "event_type")
    for spec, kind in [("pt=a/1", "error"), ("pt='b'", "click"), ("pt=a/1", "view")]:
        sync.write_files(rows.where(F.col("event_type") == kind), target, partition=sync.partition_spec(spec))
    return spark.read.parquet(target).groupBy("pt", "event_type").agg(F.count(F.lit(1)).alias("n"))


_TARGETS = [("id", "id", "bigint"), ("amount_text", "amount", "decimal(10,0)"), ("kind", "kind", "string")]


@query("a12_split_dirty", """
SELECT 'good' AS part, id, CAST(CAST(amount_text AS INTEGER) AS VARCHAR) AS v FROM sync_source WHERE amount_text <> 'bad'
UNION ALL SELECT 'dirty', id, 'amount' FROM sync_source WHERE amount_text = 'bad'
""")
def _(f):
    good, dirty = sync.split_dirty(f.sync_source, _TARGETS)
    bad_id = F.get_json_object("row", "$.id").cast("long")
    return good.select(F.lit("good").alias("part"), "id", F.col("amount").cast("string").alias("v")).unionByName(
        dirty.select(F.lit("dirty").alias("part"), bad_id.alias("id"), F.array_join("faults", ",").alias("v")))


@query("a13_sync_report", """
SELECT count(*) AS "numRead", count(*) FILTER (amount_text <> 'bad' AND kind IS NOT NULL) AS "numWrite",
count(*) FILTER (amount_text = 'bad' OR kind IS NULL) AS "nErrors", count(*) FILTER (amount_text = 'bad') AS
"conversionErrors", count(*) FILTER (amount_text <> 'bad' AND kind IS NULL) AS "nullErrors",
CAST(0 AS BIGINT) AS "otherErrors",
CAST(count(*) FILTER (amount_text <> 'bad') - count(DISTINCT amount_text) + 1 AS BIGINT) AS "duplicateErrors"
FROM sync_source
""")
def _(f):
    return sync.sync_report(f.sync_source, _TARGETS, required=["kind"], key=["amount"])


@query("a14_sync_with_dirty_rows", """
SELECT 'good' AS part, count(*) AS n FROM sync_source WHERE amount_text <> 'bad' AND kind IS NOT NULL
UNION ALL SELECT 'dirty', count(*) FROM sync_source WHERE amount_text = 'bad' OR kind IS NULL
""")
def _(f):
    spark = f._spark
    f.sync_source.createOrReplaceTempView("sync_source")
    target, dirty = _fresh(spark, "good"), _fresh(spark, "dirty")
    job = {"content": [{
        "reader": {"customSql": "SELECT id, amount_text, kind FROM sync_source"},
        "writer": {"path": target, "fileType": "parquet", "column": [
            {"name": n, "index": i, "type": t} for i, (_, n, t) in enumerate(_TARGETS)]}}],
        "setting": {"errorLimit": {"percentage": 50.0}, "dirty": {"path": dirty}}}
    sync.sync(spark, job, required=["kind"], run="20240131", task_name="copy")
    bad = spark.read.parquet(dirty).where("task_name = 'copy'")
    return spark.read.parquet(target).agg(F.lit("good").alias("part"), F.count(F.lit(1)).alias("n")).unionByName(
        bad.agg(F.lit("dirty").alias("part"), F.count(F.lit(1)).alias("n")))


@query("a16_sync_incremental", """
SELECT 'first' AS run, count(*) AS n, max(event_id) AS last FROM events WHERE event_type <> 'view'
UNION ALL SELECT 'second', count(*), max(event_id) FROM events WHERE event_id > (SELECT max(event_id) FROM events
WHERE event_type = 'signup') UNION ALL SELECT 'backfill', count(*), max(event_id) FROM events
""")
def _(f):
    spark = f._spark
    f.events.createOrReplaceTempView("events")
    schema = "task_id long, id long, status int, cyc_time string, end_location string"
    history = spark.createDataFrame([(1, 1, 8, "20240101000000", "5")], schema)
    last = f.events.where("event_type = 'signup'").agg(
        F.lit(1).cast("long").alias("task_id"), F.lit(2).cast("long").alias("id"), F.lit(5).alias("status"),
        F.lit("20240102000000").alias("cyc_time"), F.max("event_id").cast("string").alias("end_location"))
    out = None
    for run, sql, past, mode in [
            ("first", "SELECT event_id AS id FROM events WHERE event_type <> 'view'", history, "normal"),
            ("second", "SELECT event_id AS id FROM events", history.unionByName(last), "normal"),
            ("backfill", "SELECT event_id AS id FROM events", history.unionByName(last), "backfill")]:
        target = _fresh(spark, "inc")
        job = {"content": [{"reader": {"customSql": sql, "increColumn": "id"},
                            "writer": {"path": target, "column": [{"name": "id", "index": 0, "type": "bigint"}]}}]}
        sync.sync_incremental(spark, job, past, 1, "20240103000000", mode=mode)
        one = spark.read.parquet(target).agg(
            F.lit(run).alias("run"), F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a18_sync_stream", "SELECT event_id AS id, CAST(floor(value) AS BIGINT) AS amount FROM events")
def _(f):
    spark = f._spark
    target, checkpoint = _fresh(spark, "stream"), _fresh(spark, "stream-state")
    job = {"content": [{
        "reader": {"path": f._folder, "column": [{"name": "event_id"}, {"name": "value"}]},
        "writer": {"path": target, "column": [{"name": "id", "index": 0, "type": "bigint"},
                                              {"name": "amount", "index": 1, "type": "double"}]}}],
        "setting": {"restore": {"isRestore": True}}}
    schema = ", ".join(f"{n} {t}" for n, t in f.events.dtypes)
    for _ in range(2):  # the second run finds nothing new
        sync.sync_stream(spark, job, checkpoint, schema, {"pathGlobFilter": "events.parquet"}).awaitTermination()
    return spark.read.parquet(target).select("id", F.floor("amount").alias("amount"))


_AMOUNT = "TRY_CAST(amount_text AS BIGINT)"


@query("a18_sync_stream_dirty", f"""
SELECT 'report' AS kind, count(*) AS n, CAST(count(*) - count_if({_AMOUNT} IS NULL OR kind IS NULL) AS BIGINT) AS good,
CAST(count_if({_AMOUNT} IS NULL) AS BIGINT) AS broken, CAST(count_if({_AMOUNT} IS NOT NULL AND kind IS NULL) AS BIGINT) AS missing FROM sync_source
UNION ALL SELECT 'rows', count(*), CAST(sum({_AMOUNT}) AS BIGINT), max(id), min(id) FROM sync_source WHERE {_AMOUNT} IS NOT NULL AND kind IS NOT NULL
UNION ALL SELECT 'dirty', count(*), 0, 0, 0 FROM sync_source WHERE {_AMOUNT} IS NULL OR kind IS NULL
""")
def _(f):
    """Three deliveries with a restart after each."""
    spark = f._spark
    base = _fresh(spark, "restored")
    job = {"content": [{
        "reader": {"path": f"{base}/in", "column": [{"name": c} for c in ("id", "amount_text", "kind")]},
        "writer": {"path": f"{base}/out", "column": [
            {"name": "id", "type": "bigint"}, {"name": "amount", "type": "bigint"}, {"name": "kind", "type": "string"}]}}],
        "setting": {"restore": {"isRestore": True}, "errorLimit": {"percentage": 90}, "dirty": {"path": f"{base}/dirty"}}}
    for k in range(3):
        f.sync_source.where(F.col("id") % 3 == k).write.mode("append").parquet(f"{base}/in")
        schema = ", ".join(f"{n} {t}" for n, t in f.sync_source.dtypes)
        sync.sync_stream(spark, job, f"{base}/state", schema, required=["kind"]).awaitTermination()
    zero = F.lit(0).cast("long")
    report = sync.stream_report(spark, f"{base}/state").select(
        F.lit("report").alias("kind"), F.col("numRead").alias("n"), F.col("numWrite").alias("good"), F.col("conversionErrors").alias("broken"),
        F.col("nullErrors").alias("missing"))
    rows = spark.read.parquet(f"{base}/out").agg(
        F.lit("rows").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("amount").alias("good"), F.max("id").alias("broken"), F.min("id").alias("missing"))
    dirty = spark.read.parquet(f"{base}/dirty").agg(
        F.lit("dirty").alias("kind"), F.count(F.lit(1)).alias("n"), zero.alias("good"), zero.alias("broken"), zero.alias("missing"))
    return report.unionByName(rows).unionByName(dirty)


@query("a16_start_locations", """
WITH r AS (SELECT c_custkey AS id, c_custkey % 50 AS task_id, c_custkey AS job_id, CASE WHEN c_custkey % 3 = 0 THEN 8 ELSE 5 END AS status,
  strftime(TIMESTAMP '2024-01-05' + INTERVAL 1 DAY * (c_custkey % 20), '%Y%m%d%H%M%S') AS cyc,
  TIMESTAMP '2024-01-05 00:00:00' + INTERVAL 1 HOUR * c_nationkey AS lo, TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 1 HOUR * c_nationkey AS hi FROM customer),
e AS (SELECT id, CAST(sum(CAST(trunc(greatest(v, 0)) AS BIGINT)) AS VARCHAR) AS loc FROM (
  SELECT r.id, event_id % 4 AS sub, max_by(value, ts) AS v FROM r JOIN events e ON e.user_id = r.job_id
  WHERE r.status = 5 AND event_type = 'signup' AND epoch_ms(ts) BETWEEN epoch_ms(lo) AND epoch_ms(hi) + 60000 GROUP BY ALL) z
  GROUP BY id HAVING sum(CAST(trunc(greatest(v, 0)) AS BIGINT)) <> 0),
d AS (SELECT task_id, arg_max_null(loc, (cyc, id)) AS loc FROM r LEFT JOIN e USING (id) WHERE status = 5 AND cyc < '20240120000000' GROUP BY task_id)
SELECT DISTINCT task_id, d.loc AS start_location FROM r LEFT JOIN d USING (task_id)
""")
def _(f):
    from opsframe.suite.series import _named

    at = F.lit(dt.datetime(2024, 1, 5)).cast("timestamp_ntz")
    hours = F.make_dt_interval(hours=F.col("c_nationkey").cast("int"))
    key = F.col("c_custkey")
    runs = f.customer.select(
        key.alias("id"), (key % 50).alias("task_id"), key.alias("job_id"), F.when(key % 3 == 0, 8).otherwise(5).alias("status"),
        F.date_format(at + F.make_dt_interval(days=(key % 20).cast("int")), "yyyyMMddHHmmss").alias("cyc_time"), (at + hours).alias("exec_start_time"),
        (F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz") + hours).alias("exec_end_time"))
    return sync.start_locations(sync.with_end_locations(runs, _named(f)), "20240120000000")


@query("a11_partition_map", """
SELECT id, strftime(cyc_ts, '%Y/%m') AS pt FROM job_runs
""")
def _(f):
    spec = F.concat(F.lit("pt="), F.date_format("cyc_ts", "yyyy/MM"))
    return f.job_runs.select("id", partition_map(spec)["pt"].alias("pt"))


@query("a20_cube_segment", """
SELECT l_returnflag, l_linestatus, l_linenumber, CAST(grouping(l_returnflag, l_linestatus, l_linenumber) AS INTEGER)
AS grouping, count(l_orderkey) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, max(l_shipdate) AS last FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1999-01-01'
GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)
""")
def _(f):
    rows = f.lineitem.withColumn("l_quantity", F.col("l_quantity").cast("long"))
    start, end = dt.datetime(1996, 1, 1), dt.datetime(1999, 1, 1)
    segment = cube.cube_segment(
        rows, ["l_returnflag", "l_linestatus", "l_linenumber"],
        {"n": ("count", "l_orderkey"), "qty": ("sum", "l_quantity"), "last": ("max", "l_shipdate")}, "l_shipdate",
        start, end)
    target = _fresh(f._spark, "cube")
    for _ in range(2):  # building a slice again replaces it
        cube.write_segment(segment, target, start, end)
    return f._spark.read.parquet(target).drop("segment")


@query("d31_grouping_sets", """
SELECT project_id, period_type, count(*) AS n FROM jobs GROUP BY ROLLUP (project_id, period_type)
""")
def _(f):
    return f.jobs.rollup("project_id", "period_type").agg(F.count(F.lit(1)).alias("n"))

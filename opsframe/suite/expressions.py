"""Scalar expressions (I) and their SQL forms (M), over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsframe.functions import params, sqlfuncs, text
from opsframe.suite import query
from opsframe.suite.calendar import _tasks, triggers

NOW = "20240131103000"


def _fmt(expr: str, pattern: str = "%Y%m%d%H%M%S") -> str:
    return f"strftime({expr}, '{pattern}')"


def _params(kind: str, cases: list[tuple[str, str]]):
    """Spark columns and oracle columns for a list of (command, DuckDB expression)."""
    def build(f):
        code = params.SYSTEM if kind == "sys" else params.CUSTOM
        commands = {f"p{i}": (code, command) for i, (command, _) in enumerate(cases)}
        return params.add_params(f.job_runs, commands, F.col("cyc_time"), F.lit(NOW)).select("id", *commands)

    return build, "SELECT id, " + ", ".join(f"{sql} AS p{i}" for i, (_, sql) in enumerate(cases)) + " FROM job_runs"


_CASES = {
    "i01_sys_param": ("sys", [
        ("", "''"), ("yyyyMMddHHmmss", "cyc_time"), ("yyyyMMdd", "left(cyc_time, 8)"),
        ("yyyyMMdd-1", _fmt("cyc_ts - INTERVAL 1 DAY", "%Y%m%d")),
        ("yyyyMM + 2", _fmt("cyc_ts + INTERVAL 2 MONTH", "%Y%m")),
        ("yyyy-3", _fmt("cyc_ts - INTERVAL 3 YEAR", "%Y")),
        ("yyyy-MM-dd,-1", _fmt("cyc_ts - INTERVAL 1 DAY", "%Y-%m-%d")),
        ("yyyy-MM-dd,+40", _fmt("cyc_ts + INTERVAL 40 DAY", "%Y-%m-%d"))]),
    "i02_custom_days": ("custom", [
        ("$[yyyyMMdd-1]", _fmt("cyc_ts - INTERVAL 1 DAY", "%Y%m%d")),
        ("$[yyyyMMdd + 7*2]", _fmt("cyc_ts + INTERVAL 14 DAY", "%Y%m%d")),
        ("$[yyyyMMdd-3*7]", _fmt("cyc_ts - INTERVAL 21 DAY", "%Y%m%d"))]),
    "i03_custom_hours": ("custom", [
        ("$[hh24miss-1/24]", _fmt("cyc_ts - INTERVAL 1 HOUR")), ("$[hh24miss + 30/24]", _fmt("cyc_ts + INTERVAL 30 HOUR")),
        ("$[hh24miss+5/24/60]", _fmt("cyc_ts + INTERVAL 5 MINUTE")),
        ("$[hh24miss-90/24/60]", _fmt("cyc_ts - INTERVAL 90 MINUTE"))]),
    "i04_add_months": ("custom", [
        ("$[add_months(yyyyMMdd,1)]", _fmt("cyc_ts + INTERVAL 1 MONTH", "%Y%m%d")),
        ("$[add_months(yyyyMM,12*-1)]", _fmt("cyc_ts - INTERVAL 12 MONTH", "%Y%m")),
        ("$[add_months(yyyyMMdd, -2, '-')]", _fmt("cyc_ts - INTERVAL 2 MONTH", "%Y-%m-%d")),
        ("$[add_months(yyyy,2*12)]", _fmt("cyc_ts + INTERVAL 2 YEAR", "%Y"))]),
    "i05_plain_patterns": ("custom", [
        ("$[yyyyMM]", _fmt("cyc_ts", "%Y%m")), ("$[HH:mm:ss]", _fmt("cyc_ts", "%H:%M:%S")),
        ("$[yyyyMMddhh24mm]", _fmt("cyc_ts", "%Y%m%d%H%M")), ("$[yyyy-MM-dd HH:mm:ss]", _fmt("cyc_ts", "%Y-%m-%d %H:%M:%S")),
        ("$[hh24]", _fmt("cyc_ts", "%H"))]),
    "i06_format_calls": ("custom", [
        ("$[format(yyyyMMdd-1d,'yyyy/MM/dd')]", _fmt("cyc_ts - INTERVAL 1 DAY", "%Y/%m/%d")),
        ("$[format(yyyyMMddHHmmss+3H,'yyyyMMddHHmmss')]", _fmt("cyc_ts + INTERVAL 3 HOUR")),
        ("$[format(yyyyMMdd+1M,'yyyyMMdd')]", _fmt("cyc_ts + INTERVAL 1 MONTH", "%Y%m%d")),
        ("$[format(yyyyMMdd-2y,'yyyy')]", _fmt("cyc_ts - INTERVAL 2 YEAR", "%Y")),
        ("$[format(yyyyMMdd+15m,'HH:mm')]", _fmt("cyc_ts + INTERVAL 15 MINUTE", "%H:%M")),
        ("$[format(yyyyMMdd-1w,'yyyyMMdd')]", _fmt("cyc_ts - INTERVAL 7 DAY", "%Y%m%d")),
        ("$[format(yyyyMMdd+20s,'HHmmss')]", _fmt("cyc_ts + INTERVAL 20 SECOND", "%H%M%S")),
        ("$[format(yyyyMMdd,'yyyyMMdd')]", _fmt("cyc_ts", "%Y%m%d"))]),
    "i07_output_names": ("custom", [
        ("$[format(yyyyMMdd-1d,'UnixTimestamp10')]", "CAST(CAST(epoch(cyc_ts - INTERVAL 1 DAY) AS BIGINT) AS VARCHAR)"),
        ("$[format(yyyyMMdd+1d,'UnixTimestamp13')]", "CAST(epoch_ms(cyc_ts + INTERVAL 1 DAY) AS VARCHAR)"),
        ("$[format(yyyyMMdd+1H,'ISODate')]", _fmt("cyc_ts + INTERVAL 1 HOUR", "%Y-%m-%dT%H:%M:%SZ"))]),
    "i08_separator": ("custom", [
        ("$[yyyyMMdd-1,'-']", _fmt("cyc_ts - INTERVAL 1 DAY", "%Y-%m-%d")),
        ("$[hh24miss-1/24,'/']", _fmt("cyc_ts - INTERVAL 1 HOUR", "%Y/%m/%d/%H/%M/%S")),
        ("$[yyyyMM,'_']", _fmt("cyc_ts", "%Y_%m"))]),
    "i09_bases": ("custom", [
        ("${yyyyMMdd}", _fmt("cyc_ts - INTERVAL 1 DAY", "%Y%m%d")),
        ("${hh24miss-1/24}", _fmt("cyc_ts - INTERVAL 25 HOUR")), ("$(yyyyMMdd-1)", "'20240130'"),
        ("$(format(yyyyMMdd+1d,'yyyy-MM-dd'))", "'2024-02-01'"), ("${bdp.system.currenttime}", f"'{NOW}'"),
        ("1234", "'1234'")]),
    "i10_invalid": ("custom", [("$[nothing]", "NULL"), ("$[yyyyMMdd-3*5]", "NULL"), ("$[add_months(HH,1)]", "NULL")]),
}

for _name, (_kind, _list) in _CASES.items():
    _build, _sql = _params(_kind, _list)
    query(_name, _sql)(_build)


_PARAM_ROWS = """
SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 END AS type, concat('p', n_nationkey % 3) AS param_name,
CASE n_nationkey % 3 WHEN 0 THEN 'yyyyMMdd-1' WHEN 1 THEN '$[yyyyMM]' ELSE 'fixed' END AS param_command FROM nation"""


@query("i11_resolve_params", f"""
SELECT id, p.k, CASE p.k % 3 WHEN 0 THEN {_fmt('cyc_ts - INTERVAL 1 DAY', '%Y%m%d')} WHEN 1 THEN {_fmt('cyc_ts', '%Y%m')}
ELSE 'fixed' END AS value FROM job_runs j JOIN ({_PARAM_ROWS}) p ON p.k = j.task_id % 25
""")
def _(f):
    k = F.col("n_nationkey")
    rows = f.nation.select(
        k.alias("k"), F.when(k % 3 == 0, 0).otherwise(1).alias("type"),
        F.concat(F.lit("p"), (k % 3).cast("string")).alias("param_name"),
        F.when(k % 3 == 0, "yyyyMMdd-1").when(k % 3 == 1, "$[yyyyMM]").otherwise("fixed").alias("param_command"))
    runs = f.job_runs.select("id", (F.col("task_id") % 25).cast("int").alias("k"), "cyc_time")
    return params.resolve_params(runs.join(rows, "k"), F.col("cyc_time"), F.lit(NOW)).select("id", "k", "value")


@query("i12_render", f"""
SELECT id, concat('insert into t', task_id % 10, ' select ', {_fmt('cyc_ts - INTERVAL 1 DAY', '%Y%m%d')}, ', x', fill_id,
', ${{other}}') AS rendered FROM job_runs
""")
def _(f):
    runs = f.job_runs.withColumn("script", F.concat(
        F.lit("insert into t"), (F.col("task_id") % 10).cast("string"), F.lit(" select ${day}, ${tag}, ${other}")))
    runs = params.add_params(runs, {"day": (params.SYSTEM, "yyyyMMdd-1")}, F.col("cyc_time"), F.lit(NOW))
    values = F.create_map(F.lit("day"), F.col("day"), F.lit("tag"),
                          F.concat(F.lit("x"), F.col("fill_id").cast("string")))
    return runs.select("id", params.render(F.col("script"), values).alias("rendered"))


@query("i12_render_tasks", f"""
SELECT id, concat('select ', {_fmt('cyc_ts - INTERVAL 1 DAY', '%Y%m%d')}, ' from ', c_mktsegment, ' -- ${{x}}') AS rendered
FROM job_runs JOIN customer ON c_custkey = task_id
""")
def _(f):
    base = f.customer.select(F.col("c_custkey").alias("task_id"), "c_mktsegment")
    rows = base.select("task_id", F.lit(0).alias("type"), F.lit("d").alias("param_name"),
                       F.lit("yyyyMMdd-1").alias("param_command")).unionByName(
        base.select("task_id", F.lit(1).alias("type"), F.lit("seg").alias("param_name"),
                    F.col("c_mktsegment").alias("param_command")))
    runs = f.job_runs.withColumn("script", F.lit("select ${d} from ${seg} -- ${x}"))
    return params.render_tasks(runs, rows, "script", F.lit(NOW)).select("id", "rendered")


_DURATION = """CASE WHEN {ms} IS NULL OR {ms} = 0 THEN '0秒' WHEN {ms} < 1000 THEN concat({ms}, '毫秒') ELSE concat(
  CASE WHEN {ms} // 3600000 > 0 THEN concat({ms} // 3600000, '小时') ELSE '' END,
  CASE WHEN {ms} // 60000 % 60 > 0 THEN concat({ms} // 60000 % 60, '分钟') ELSE '' END,
  CASE WHEN {ms} // 1000 % 60 > 0 THEN concat({ms} // 1000 % 60, '秒') ELSE '' END) END"""


@query("i17_weeks_and_months", """
SELECT event_id, CASE WHEN month(b) - month(a) + 1 < 1 THEN month(b) - month(a) + 13 ELSE month(b) - month(a) + 1 END AS months,
CASE WHEN weekofyear(b) - weekofyear(a) + 1 < 1 THEN weekofyear(b) + weekofyear(make_date(year(a), 12, 28)) -
weekofyear(a) + 1 ELSE weekofyear(b) - weekofyear(a) + 1 END AS weeks
FROM (SELECT event_id, CAST(ts AS DATE) AS a, CAST(ts AS DATE) + CAST(event_id % 300 AS INTEGER) AS b FROM events) d
""")
def _(f):
    a = F.col("ts").cast("date")
    b = F.date_add(a, (F.col("event_id") % 300).cast("int"))
    return f.events.select(
        "event_id", text.months_between_incl(a, b).cast("long").alias("months"),
        text.weeks_between(a, b).cast("long").alias("weeks"))


@query("i18_duration_text", f"SELECT id, {_DURATION.format(ms='(exec_time * exec_time)')} AS d FROM jobs")
def _(f):
    return f.jobs.select("id", text.duration_text(F.col("exec_time") * F.col("exec_time")).alias("d"))


@query("i19_time_text", """
SELECT id, strftime(cyc_ts, '%Y-%m-%d %H:%M:%S') AS dashed, cyc_time AS plain, job_name AS other FROM job_runs
""")
def _(f):
    dashed = text.split_time(F.col("cyc_time"))
    return f.job_runs.select("id", dashed.alias("dashed"), text.strip_time(dashed).alias("plain"),
                             text.split_time(F.col("job_name")).alias("other"))


@query("i20_mem_mb", """
SELECT p_partkey, p_size * 1024 AS g, p_size AS m, p_size AS n, CAST(NULL AS INTEGER) AS bad FROM part
""")
def _(f):
    s = F.col("p_size").cast("string")
    return f.part.select(
        "p_partkey", text.mem_mb(F.concat(s, F.lit("G"))).alias("g"), text.mem_mb(F.concat(s, F.lit("m"))).alias("m"),
        text.mem_mb(s).alias("n"), text.mem_mb(F.concat(s, F.lit("x"))).alias("bad"))


@query("i21_capacity_mb", """
SELECT p_partkey, p_size * 1024 AS g, p_size AS m, p_size * 100 // 1024 AS k, 512 AS bad FROM part
""")
def _(f):
    s = F.col("p_size").cast("string")
    return f.part.select(
        "p_partkey", text.capacity_mb(F.concat(s, F.lit(" gb"))).alias("g"),
        text.capacity_mb(F.concat(s, F.lit("MB"))).alias("m"),
        text.capacity_mb(F.concat((F.col("p_size") * 100).cast("string"), F.lit("k"))).alias("k"),
        text.capacity_mb(F.concat(s, F.lit("tb"))).alias("bad"))


@query("i23_properties", """
SELECT task_id, concat(task_id % 4 + 1, 'g') AS memory, CAST(owner_user_id AS VARCHAR) AS owner, 'a=b' AS pair,
CAST(NULL AS VARCHAR) AS hidden FROM tasks
""")
def _(f):
    doc = F.concat(F.lit("# note\nowner = x\n\n"), "task_params", F.lit("\n#hidden=1\nowner ="),
                   F.col("owner_user_id").cast("string"), F.lit("\npair=a=b"))
    m = text.properties(doc)
    return f.tasks.select(
        "task_id", F.try_element_at(m, F.lit("driver.memory")).alias("memory"),
        F.try_element_at(m, F.lit("owner")).alias("owner"), F.try_element_at(m, F.lit("pair")).alias("pair"),
        F.try_element_at(m, F.lit("hidden")).alias("hidden"))


@query("i25_split_outside", """
SELECT p_partkey, 4 AS n, concat('f(', p_partkey, ',1)') AS a, concat('"', p_name, ',x"') AS b FROM part
""")
def _(f):
    line = F.concat(F.lit("f("), F.col("p_partkey").cast("string"), F.lit(',1),"'), "p_name", F.lit(',x",[1,2],z'))
    parts = text.split_outside(line, ",")
    return f.part.select("p_partkey", F.size(parts).alias("n"), parts[0].alias("a"), parts[1].alias("b"))


@query("i26_json_members", """
SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS VARCHAR) AS got,
concat('{"reader":{"startLocation":"', event_id, '","table":"t"}}') AS put, '{"reader":{"table":"t"}}' AS dropped FROM events
""")
def _(f):
    doc = F.lit('{"reader":{"increColumn":"id","table":"t"}}')
    dropped = text.json_drop(doc, "reader", "increColumn")
    return f.events.select(
        "event_id", text.json_get(F.col("props"), "$.k").alias("got"),
        text.json_put(dropped, ["reader", "startLocation"], F.col("event_id").cast("string")).alias("put"),
        dropped.alias("dropped"))


@query("i26_json_edit", """
SELECT event_id, concat('{"job":{"reader":{"sql":"a,}b{', event_id, '","startLocation":"', user_id, '"},"writer":{"startLocation":', event_id, '}}}') AS put,
concat('{"job":{"reader":{"sql":"a,}b{', event_id, '"},"writer":{"startLocation":', event_id, '}}}') AS dropped,
concat('{"job":{"reader":{"sql":"a,}b{', event_id, '","startLocation":"old"},"setting":{"restore":{"at":"', event_type, '"}},"writer":{"startLocation":', event_id, '}}}') AS made
FROM events
""")
def _(f):
    """The same member in reader and writer, braces in a text, an absent parent."""
    doc = F.format_string('{"job": {"writer": {"startLocation": %d}, "reader": {"startLocation": "old", "sql": "a,}b{%d"}}}', "event_id", "event_id")
    place = ["job", "reader", "startLocation"]
    return f.events.select(
        "event_id", text.json_put(doc, place, F.col("user_id")).alias("put"), text.json_drop(doc, *place).alias("dropped"),
        text.json_put(doc, ["job", "setting", "restore", "at"], F.col("event_type")).alias("made"))


@query("i27_source_key", """
SELECT s_suppkey, concat('h', s_suppkey, '.x#3306') AS mysql, concat('10.0.0.', s_nationkey, '#1521') AS oracle,
concat('h', s_suppkey, '#10000') AS hive, concat('a#2181,b', s_suppkey, '#2181') AS hbase,
concat('a#1,b#', s_suppkey) AS hbase_each, concat('zk', s_suppkey, '#2181') AS phoenix FROM supplier
""")
def _(f):
    s, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")

    def key(kind, *parts):
        return text.source_key(F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]), F.lit(kind))

    return f.supplier.select(
        "s_suppkey", key(1, "jdbc:mysql://h", s, ".x:3306/db1").alias("mysql"),
        key(2, "jdbc:oracle:thin:@10.0.0.", n, ":1521:orcl").alias("oracle"),
        key(7, "jdbc:hive2://h", s, ":10000/dev;principal=hive/x@Y").alias("hive"),
        key(8, "a,b", s, ":2181").alias("hbase"), key(8, "a:1,b:", s).alias("hbase_each"),
        key(30, "jdbc:phoenix:zk", s, ":2181/hbase").alias("phoenix"))


@query("i28_resource_names", """
SELECT s_suppkey, concat('spark_my_cluster', s_suppkey, '_q_batch_yarn') AS long_key,
concat('my_cluster', s_suppkey) AS long_cluster, concat('spark_my_cluster', s_suppkey, '_q_yarn') AS short_key,
concat('my_cluster', s_suppkey) AS short_cluster FROM supplier
""")
def _(f):
    c = F.concat(F.lit("my_cluster"), F.col("s_suppkey").cast("string"))
    long_key = text.resource_key(F.lit("spark"), c, F.lit("q"), F.lit("yarn"), F.lit("BATCH"))
    short_key = text.resource_key(F.lit("spark"), c, F.lit("q"), F.lit("yarn"))
    return f.supplier.select("s_suppkey", long_key.alias("long_key"), text.cluster_of(long_key).alias("long_cluster"),
                             short_key.alias("short_key"), text.cluster_of(short_key, False).alias("short_cluster"))


@query("i31_partition_map", """
SELECT id, strftime(cyc_ts, '%Y/%m') AS pt, CAST(task_id AS VARCHAR) AS ds, left(cyc_time, 8) AS a FROM job_runs
""")
def _(f):
    one = F.concat(F.lit("pt="), F.date_format("cyc_ts", "yyyy/MM"))
    two = F.concat(F.lit("pt='"), F.substring("cyc_time", 1, 8), F.lit("'/ds=\""), F.col("task_id").cast("string"),
                   F.lit('"'))
    return f.job_runs.select(
        "id", text.partition_map(one)["pt"].alias("pt"), text.partition_map(two)["ds"].alias("ds"),
        text.partition_map(two)["pt"].alias("a"))


@query("m01_sql_functions", f"""
SELECT id, {_DURATION.format(ms='(exec_time * 1000)')} AS d, strftime(cyc_ts, '%Y-%m-%d %H:%M:%S') AS t,
strftime(cyc_ts + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y%m%d%H%M%S') AS s, task_id AS k, strftime(cyc_ts, '%Y-%m-%d') AS b
FROM job_runs
""")
def _(f):
    runs = f.job_runs
    sqlfuncs.register(runs.sparkSession)
    return runs.selectExpr(
        "id", "duration_text(exec_time * 1000) AS d", "split_time(cyc_time) AS t",
        "cyc_shift(cyc_shift(cyc_time, 0, 1, 0, 0, 0), 0, 0, -1, 0, 0) AS s", "key_task(job_key) AS k",
        "biz_day(cyc_time) AS b")


@query("m02_triggers_function", """
SELECT task_id, TIMESTAMP '1998-03-15' + INTERVAL 1 MINUTE * m AS trigger_time FROM tasks JOIN (
SELECT 0 AS p, unnest(range(0, 1440, 30)) AS m UNION ALL SELECT 1, unnest([135, 435, 735, 1035, 1335])
UNION ALL SELECT 2, 90 UNION ALL SELECT 3, 1380 UNION ALL SELECT 4, 23) s ON p = period_type
""")
def _(f):
    tasks = _tasks(f)
    spark = tasks.sparkSession
    sqlfuncs.register(spark)
    return spark.sql("SELECT t.task_id, x.trigger_time FROM {t} t, LATERAL triggers(t.schedule_conf, '1998-03-15') x",
                     t=tasks)


@query("m02_triggers_of_all_rules", f"""
SELECT task_id, ts AS trigger_time FROM ({triggers('1998-02-27', '1998-03-04')}) x
""")
def _(f):
    """The table function gives what ``g01`` gives, on the same rules."""
    rules = _tasks(f)
    spark = rules.sparkSession
    sqlfuncs.register(spark)
    days = spark.range(6).select(F.date_add(F.lit(dt.date(1998, 2, 27)), F.col("id").cast("int")).cast("string").alias("day"))
    return spark.sql("SELECT t.task_id, x.trigger_time FROM {t} t CROSS JOIN {d} d, LATERAL triggers(t.schedule_conf, d.day) x",
                     t=rules, d=F.broadcast(days))


# --- plain built-ins, used inline by other operators ------------------------------------------------

@query("i13_period_starts", """
SELECT event_id, date_trunc('day', ts) AS d, date_trunc('day', ts) + INTERVAL 1 DAY AS nd, date_trunc('minute', ts) AS mi,
date_trunc('hour', ts) AS h, CAST(date_trunc('month', ts) AS TIMESTAMP) AS mo, CAST(date_trunc('week', ts) AS TIMESTAMP) AS w
FROM events
""")
def _(f):
    def start(unit):
        return F.date_trunc(unit, "ts").cast("timestamp_ntz")

    return f.events.select(
        "event_id", start("day").alias("d"), (start("day") + F.make_dt_interval(days=F.lit(1))).alias("nd"),
        start("minute").alias("mi"), start("hour").alias("h"), start("month").alias("mo"), start("week").alias("w"))


@query("i14_date_parts", "SELECT id, CAST(year(cyc_ts) AS INTEGER) AS y, CAST(month(cyc_ts) AS INTEGER) AS m, "
       "CAST(weekofyear(cyc_ts) AS INTEGER) AS w FROM jobs")
def _(f):
    return f.jobs.select("id", F.year("cyc_ts").alias("y"), F.month("cyc_ts").alias("m"),
                         F.weekofyear("cyc_ts").alias("w"))


@query("i15_month_bounds", """
SELECT id, strftime(date_trunc('month', cyc_ts), '%Y-%m-%d') AS first, strftime(last_day(cyc_ts), '%Y-%m-%d') AS last,
strftime(date_trunc('month', cyc_ts) - INTERVAL 1 MONTH, '%Y-%m-%d') AS prev_first,
strftime(date_trunc('month', cyc_ts) - INTERVAL 1 DAY, '%Y-%m-%d') AS prev_last FROM jobs
""")
def _(f):
    first = F.trunc("cyc_ts", "month")
    return f.jobs.select(
        "id", first.cast("string").alias("first"), F.last_day("cyc_ts").cast("string").alias("last"),
        F.add_months(first, -1).cast("string").alias("prev_first"), F.date_sub(first, 1).cast("string").alias("prev_last"))


@query("i16_shift_day", """
SELECT id, strftime(cyc_ts - INTERVAL 1 DAY, '%Y%m%d') AS yesterday, strftime(cyc_ts + INTERVAL 30 DAY, '%Y-%m-%d') AS later
FROM job_runs
""")
def _(f):
    day = F.to_date(F.substring("cyc_time", 1, 8), "yyyyMMdd")
    return f.job_runs.select("id", F.date_format(F.date_sub(day, 1), "yyyyMMdd").alias("yesterday"),
                             F.date_format(F.date_add(day, 30), "yyyy-MM-dd").alias("later"))


@query("i22_lenient_casts", """
SELECT id, TRY_CAST(nullif(trim(amount_text), '') AS INTEGER) AS v, coalesce(TRY_CAST(amount_text AS INTEGER), -1) AS d
FROM sync_source
""")
def _(f):
    v = F.nullif(F.trim("amount_text"), F.lit("")).try_cast("int")
    return f.sync_source.select("id", v.alias("v"), F.coalesce(v, F.lit(-1)).alias("d"))


@query("i24_int_list", "SELECT s_suppkey, s_nationkey + 7 + s_suppkey AS total, 3 AS n FROM supplier")
def _(f):
    text_ = F.concat(F.col("s_nationkey").cast("string"), F.lit(",, 7,"), F.col("s_suppkey").cast("string"))
    items = F.transform(F.filter(F.split(text_, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))
    return f.supplier.select(
        "s_suppkey", F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.size(items).alias("n"))


@query("i29_unique_task_id", "SELECT task_id, (CAST(app_type AS BIGINT) << 56) + task_id AS uid FROM tasks")
def _(f):
    return f.tasks.select("task_id", (F.shiftleft(F.col("app_type").cast("long"), 56) + F.col("task_id")).alias("uid"))


@query("i30_biz_day", "SELECT id, strftime(cyc_ts, '%Y-%m-%d') AS day FROM job_runs")
def _(f):
    c = F.col("cyc_time")
    return f.job_runs.select("id", F.concat_ws("-", c.substr(1, 4), c.substr(5, 2), c.substr(7, 2)).alias("day"))

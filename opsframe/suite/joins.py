"""Joins (C) and table maintenance (F)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsframe import dims
from opsframe.operators import filters, joins, tables
from opsframe.suite import query

EDGE = ["input_table_id", "result_table_id"]


@query("c01_live_edges", """
SELECT input_table_id, result_table_id FROM lineage_edges e
WHERE EXISTS (SELECT 1 FROM lineage_refs r WHERE r.input_table_id = e.input_table_id
AND r.result_table_id = e.result_table_id AND r.is_deleted = 0 AND r.app_type = 1)
""")
def _(f):
    return joins.live_edges(f.lineage_edges, f.lineage_refs, 1)


@query("c02_edges_with_task", """
SELECT 'child' AS side, e.job_id, e.parent_job_id, j.task_id FROM job_edges e JOIN jobs j ON j.job_id = e.job_id
UNION ALL
SELECT 'parent', e.job_id, e.parent_job_id, j.task_id FROM job_edges e JOIN jobs j ON j.job_id = e.parent_job_id
""")
def _(f):
    a, b = (joins.edges_with_task(f.job_edges, f.jobs, s).select(
        F.lit(s).alias("side"), "job_id", "parent_job_id", "task_id") for s in ("child", "parent"))
    return a.unionByName(b)


@query("c03_top_nodes", """
SELECT task_id, flow_id FROM tasks t WHERE flow_id <> 0 AND is_deleted = 0
AND NOT EXISTS (SELECT 1 FROM task_edges e JOIN tasks p ON p.task_id = e.parent_task_id
  WHERE e.task_id = t.task_id AND p.task_type = 10)
""")
def _(f):
    flows = f.tasks.where("task_type = 10").select(F.col("task_id").alias("parent_task_id"))
    edges = f.task_edges.join(flows, "parent_task_id", "left_semi")
    return joins.top_nodes(f.tasks, edges).select("task_id", "flow_id")


@query("c04_lookup", """
SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey
""")
def _(f):
    nation = f.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    region = f.region.withColumnRenamed("r_regionkey", "n_regionkey")
    return joins.lookup(f.customer, [(nation, ["c_nationkey"], "left"), (region, ["n_regionkey"], "left")]).select(
        "c_custkey", "c_name", "n_name", "r_name")


@query("c05_scalar_lookup", """
SELECT id, (SELECT name FROM tasks t WHERE t.task_id = j.task_id) AS task_name FROM jobs j
""")
def _(f):
    names = f.tasks.select("task_id", F.col("name").alias("task_name"))
    return joins.lookup(f.jobs, [(names, ["task_id"], "left")]).select("id", "task_name")


@query("c06_semi_join", "SELECT job_id, parent_job_id FROM job_edges WHERE job_id IN "
       "(SELECT job_id FROM jobs WHERE status = 5)")
def _(f):
    return f.job_edges.join(f.jobs.where("status = 5").select("job_id"), "job_id", "left_semi").select(
        "job_id", "parent_job_id")


@query("c07_anti_join", "SELECT id, job_name FROM fills WHERE id NOT IN (SELECT fill_id FROM jobs WHERE fill_id > 0 "
       "AND status = 5)")
def _(f):
    used = f.jobs.where("fill_id > 0 AND status = 5").select(F.col("fill_id").alias("id"))
    return f.fills.join(used, "id", "left_anti")


@query("c08_with_task", """
SELECT j.id, t.name AS task_name, t.owner_user_id FROM jobs j JOIN tasks t USING (task_id) WHERE t.is_deleted = 0
""")
def _(f):
    return joins.with_task(f.jobs, f.tasks.where("is_deleted = 0")).select("id", "task_name", "owner_user_id")


@query("c10_last_success", """
SELECT j.id, max_by(s.id, s.cyc_ts) AS last_id FROM jobs j LEFT JOIN jobs s
ON s.task_id = j.task_id AND s.status = 5 AND (s.cyc_ts < j.cyc_ts OR (s.cyc_ts = j.cyc_ts AND s.id < j.id))
GROUP BY j.id
""")
def _(f):
    return joins.last_success_before(f.jobs).select("id", "last_id")


@query("c10_last_success_at", """
SELECT task_id, max_by(id, cyc_ts) AS last_id, max(cyc_ts) AS last_cyc_ts FROM jobs
WHERE status = 5 AND cyc_ts < TIMESTAMP '1999-01-01 00:00:00' GROUP BY task_id
""")
def _(f):
    return joins.last_success(f.jobs, dt.datetime(1999, 1, 1))


@query("c11_previous_run", """
SELECT id, lag(id) OVER w AS prev_id, lag(status) OVER w AS prev_status FROM jobs
WINDOW w AS (PARTITION BY task_id ORDER BY id)
""")
def _(f):
    return joins.previous_run(f.jobs).select("id", "prev_id", "prev_status")


@query("c14_diff", """
WITH o AS (SELECT p_partkey AS k, p_size AS a, p_brand AS b FROM part WHERE p_type <> 'ECONOMY'),
n AS (SELECT p_partkey AS k, CASE WHEN p_brand = 'Brand#1' THEN p_size + 1 ELSE p_size END AS a, p_brand AS b
  FROM part WHERE p_type <> 'STANDARD')
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete'
WHEN o.a IS NOT DISTINCT FROM n.a AND o.b IS NOT DISTINCT FROM n.b THEN 'unchanged' ELSE 'update' END AS change,
CASE WHEN n.k IS NULL THEN o.a ELSE n.a END AS a, CASE WHEN n.k IS NULL THEN o.b ELSE n.b END AS b
FROM o FULL JOIN n ON o.k = n.k
""")
def _(f):
    rows = f.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("a"), F.col("p_brand").alias("b"),
                         "p_type")
    new = rows.withColumn("a", F.when(F.col("b") == "Brand#1", F.col("a") + 1).otherwise(F.col("a")))
    return joins.diff(rows.where("p_type <> 'ECONOMY'"), new.where("p_type <> 'STANDARD'"), ["k"], ["a", "b"])


@query("c16_dict_lookup", """
WITH d AS (SELECT n_nationkey % 2 AS type, n_regionkey AS dict_name, n_name AS dict_value, n_nationkey AS sort,
CASE WHEN n_nationkey = 7 THEN 1 ELSE 0 END AS is_default, 0 AS is_deleted FROM nation WHERE n_regionkey <> 3)
SELECT s_suppkey, coalesce((SELECT min_by(dict_value, sort) FROM d WHERE type = 1 AND dict_name = s_nationkey % 7),
(SELECT dict_value FROM d WHERE type = 1 AND is_default = 1)) AS dict_value FROM supplier
""")
def _(f):
    dictionary = f.nation.where("n_regionkey <> 3").select(
        (F.col("n_nationkey") % 2).alias("type"), F.col("n_regionkey").alias("dict_name"),
        F.col("n_name").alias("dict_value"), F.col("n_nationkey").alias("sort"),
        F.when(F.col("n_nationkey") == 7, 1).otherwise(0).alias("is_default"), F.lit(0).alias("is_deleted"))
    rows = f.supplier.select("s_suppkey", (F.col("s_nationkey") % 7).alias("dict_name"))
    return joins.dict_lookup(rows, dictionary, 1, ["dict_name"], F.col("dict_value")).select("s_suppkey", "dict_value")


# --- F -------------------------------------------------------------------------------------------

@query("f01_both_directions", """
SELECT e.input_table_id, e.result_table_id FROM lineage_edges e
UNION SELECT input_table_id, result_table_id FROM lineage_refs WHERE is_deleted = 0
""")
def _(f):
    return joins.both_directions(f.lineage_edges.select(*EDGE),
                                 f.lineage_refs.where("is_deleted = 0").select(*EDGE))


_NEW_TASKS = """
SELECT c_custkey + (SELECT count(*) FROM customer) // 2 AS task_id, concat('new', c_custkey) AS name,
c_custkey % 3 AS project_id FROM customer
"""


def _new_tasks(f):
    half = f.customer.agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))
    return f.customer.crossJoin(F.broadcast(half)).select(
        (F.col("c_custkey") + F.col("half")).alias("task_id"),
        F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("name"),
        (F.col("c_custkey") % 3).alias("project_id"))


@query("f02_upsert", f"""
SELECT coalesce(b.task_id, n.task_id) AS task_id, coalesce(n.name, b.name) AS name,
coalesce(b.project_id, n.project_id) AS project_id, b.version_id
FROM tasks b FULL JOIN ({_NEW_TASKS}) n ON b.task_id = n.task_id
""")
def _(f):
    base = f.tasks.select("task_id", "name", "project_id", "version_id")
    return tables.upsert(base, _new_tasks(f), ["task_id"], ["name"])


@query("f03_insert_new", f"""
SELECT task_id, name, project_id FROM tasks UNION ALL
SELECT task_id, name, project_id FROM ({_NEW_TASKS}) n WHERE task_id NOT IN (SELECT task_id FROM tasks)
""")
def _(f):
    return tables.insert_new(f.tasks.select("task_id", "name", "project_id"), _new_tasks(f), ["task_id"])


@query("f04_replace", f"""
SELECT task_id, name, project_id FROM ({_NEW_TASKS}) n UNION ALL
SELECT task_id, name, project_id FROM tasks WHERE task_id NOT IN (SELECT task_id FROM ({_NEW_TASKS}) n)
""")
def _(f):
    return tables.replace(f.tasks.select("task_id", "name", "project_id"), _new_tasks(f), ["task_id"])


_INCOMING = """
SELECT p_partkey AS input_table_id, p_partkey + 1 + p_partkey % 3 AS result_table_id FROM part WHERE p_size < 25
"""


def _incoming(f):
    k = F.col("p_partkey")
    return f.part.where("p_size < 25").select(
        k.alias("input_table_id"), (k + 1 + k % 3).alias("result_table_id"))


@query("f05_replace_batch", f"""
WITH n AS ({_INCOMING}), r AS (SELECT input_table_id, result_table_id, app_type, unique_key,
CASE WHEN unique_key = 'batch3' AND app_type = 1 THEN 1 ELSE is_deleted END AS is_deleted FROM lineage_refs),
m AS (SELECT *, 1 AS app_type, 'batch3' AS unique_key FROM n)
SELECT 'ref' AS kind, coalesce(r.input_table_id, m.input_table_id) AS input_table_id,
coalesce(r.result_table_id, m.result_table_id) AS result_table_id, coalesce(r.unique_key, m.unique_key) AS unique_key,
CASE WHEN m.input_table_id IS NOT NULL THEN 0 ELSE r.is_deleted END AS is_deleted
FROM r FULL JOIN m ON r.input_table_id = m.input_table_id AND r.result_table_id = m.result_table_id
AND r.app_type = m.app_type AND r.unique_key = m.unique_key
UNION ALL
SELECT 'edge', input_table_id, result_table_id, '', 0 FROM (SELECT * FROM lineage_edges UNION SELECT * FROM n) e
""")
def _(f):
    edges, refs = tables.replace_batch(f.lineage_edges, f.lineage_refs, "batch3", _incoming(f))
    return refs.select(F.lit("ref").alias("kind"), *EDGE, "unique_key", "is_deleted").unionByName(
        edges.select(F.lit("edge").alias("kind"), *EDGE, F.lit("").alias("unique_key"), F.lit(0).alias("is_deleted")))


@query("f06_edit_edges", f"""
WITH n AS ({_INCOMING})
SELECT r.input_table_id, r.result_table_id, unique_key, CASE WHEN n.input_table_id IS NOT NULL
AND unique_key = 'batch5' THEN 1 ELSE is_deleted END AS is_deleted
FROM lineage_refs r LEFT JOIN n ON n.input_table_id = r.input_table_id AND n.result_table_id = r.result_table_id
UNION ALL
SELECT input_table_id, result_table_id, 'manual', 0 FROM n
""")
def _(f):
    _, refs = tables.add_edge(f.lineage_edges, f.lineage_refs, _incoming(f), "manual")
    return tables.remove_edge(refs, _incoming(f), "batch5").select(*EDGE, "unique_key", "is_deleted")


_OLD = """
(period_type IN (0, 1) AND cyc_time < '19980616000000') OR (period_type = 2 AND cyc_time < '19980601000000')
OR (period_type IN (3, 4) AND cyc_time < '19980502000000')
"""


@query("f07_archive", f"""
WITH k AS (SELECT *, ({_OLD}) AS old FROM job_runs)
SELECT 'jobs' AS part, CASE WHEN old THEN 'archived' ELSE 'kept' END AS state, job_id AS k FROM k
UNION ALL SELECT 'fills', CASE WHEN id IN (SELECT fill_id FROM k WHERE NOT old AND fill_id > 0) THEN 'kept'
ELSE 'archived' END, CAST(id AS VARCHAR) FROM fills
UNION ALL SELECT 'edges', CASE WHEN job_id IN (SELECT job_id FROM k WHERE old) THEN 'archived' ELSE 'kept' END,
concat(job_id, '<', parent_job_id) FROM job_edges
""")
def _(f):
    parts = tables.archive(f.job_runs, f.job_edges, f.fills, dt.datetime(1998, 7, 1, 8))
    key = {"jobs": F.col("job_id"), "fills": F.col("id").cast("string"),
           "edges": F.concat("job_id", F.lit("<"), "parent_job_id")}
    out = None
    for name, pair in parts.items():
        for state, df in zip(("kept", "archived"), pair, strict=True):
            rows = df.select(F.lit(name).alias("part"), F.lit(state).alias("state"), key[name].alias("k"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query("f08_register_datasets", """
SELECT source_id, db_name, schema_name, table_name, table_key FROM (
SELECT DISTINCT p_size AS source_id, p_type AS db_name, p_type AS schema_name, p_brand AS table_name,
concat(p_size, p_type, p_brand) AS table_key FROM part)
""")
def _(f):
    seen = f.part.select(F.col("p_size").alias("source_id"), F.col("p_type").alias("db_name"),
                         F.when(F.col("p_partkey") % 2 == 0, "").alias("schema_name"),
                         F.col("p_brand").alias("table_name"))
    known = seen.where("source_id < 10").select(
        "source_id", "db_name", F.col("db_name").alias("schema_name"), "table_name",
        F.concat(F.col("source_id").cast("string"), "db_name", "table_name").alias("table_key"))
    return tables.register_datasets(known.dropDuplicates(["table_key"]), seen)


@query("f09_replace_edges", """
WITH n AS (SELECT DISTINCT l_partkey AS task_id, l_suppkey AS parent_task_id, 1 AS project_id,
  max(l_linenumber) AS app_type FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT task_id, parent_task_id, project_id, app_type FROM n UNION ALL
SELECT task_id, parent_task_id, 1, app_type FROM task_edges WHERE task_id NOT IN (SELECT task_id FROM n)
""")
def _(f):
    base = f.task_edges.select("task_id", "parent_task_id", F.lit(1).alias("project_id"), "app_type")
    new = f.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("task_id"), F.col("l_suppkey").alias("parent_task_id"), F.lit(1).alias("project_id"),
        F.col("l_linenumber").alias("app_type"))
    return tables.replace_edges(base, new, ["app_type"])


@query("f10_mark", """
SELECT id, CASE WHEN tenant_id = 2 AND operation = 'view' THEN 1 ELSE 0 END AS read_status FROM audit
""")
def _(f):
    rows = f.audit.withColumn("read_status", F.lit(0))
    return tables.mark(rows, (F.col("tenant_id") == 2) & (F.col("operation") == "view"), {"read_status": 1}).select(
        "id", "read_status")


@query("f11_expire_stale", """
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-25 11:58:20' AND status NOT IN (5, 7, 8, 9, 12, 13, 18, 21, 24, 26)
THEN 8 ELSE status END AS status FROM status_feed WHERE ts >= TIMESTAMP '2024-01-18 12:00:00'
""")
def _(f):
    return tables.expire_stale(f.status_feed, dt.datetime(2024, 1, 25, 12), modified="ts").select("event_id", "status")


@query("f12_apply_commit", """
WITH s AS (SELECT o_orderkey AS id, o_custkey AS task_id, concat('v', o_orderkey) AS name, o_orderstatus AS commit_id,
  o_orderkey % 2 AS is_commit FROM orders),
p AS (SELECT task_id, max_by(name, id) AS name FROM s WHERE commit_id = 'F' AND is_commit = 0 GROUP BY task_id)
SELECT 'base' AS kind, coalesce(t.task_id, p.task_id) AS k, coalesce(p.name, t.name) AS v FROM tasks t
FULL JOIN p ON p.task_id = t.task_id
UNION ALL SELECT 'staged', id, CASE WHEN commit_id = 'F' THEN '1' ELSE CAST(is_commit AS VARCHAR) END FROM s
""")
def _(f):
    staged = f.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("task_id"),
        F.concat(F.lit("v"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderstatus").alias("commit_id"), (F.col("o_orderkey") % 2).alias("is_commit"))
    base, flagged = tables.apply_commit(staged, f.tasks.select("task_id", "name"), "F", ["task_id"], ["name"])
    return base.select(F.lit("base").alias("kind"), F.col("task_id").alias("k"), F.col("name").alias("v")).unionByName(
        flagged.select(F.lit("staged").alias("kind"), F.col("id").alias("k"),
                       F.col("is_commit").cast("string").alias("v")))


@query("f13_clean_plan", """
WITH gone AS (SELECT job_id FROM job_runs WHERE type = 0 AND starts_with(cyc_time, '19980701'))
SELECT 'job' AS kind, job_id AS k FROM job_runs WHERE job_id NOT IN (SELECT job_id FROM gone)
UNION ALL SELECT 'edge', concat(job_id, '<', parent_job_id) FROM job_edges WHERE job_id NOT IN (SELECT job_id FROM gone)
""")
def _(f):
    runs = f.job_runs
    edges = f.job_edges.join(runs.select("job_id", "job_key"), "job_id")
    kept, left = tables.clean_plan(runs, edges, dt.date(1998, 7, 1), "task")
    return kept.select(F.lit("job").alias("kind"), F.col("job_id").alias("k")).unionByName(
        left.select(F.lit("edge").alias("kind"), F.concat("job_id", F.lit("<"), "parent_job_id").alias("k")))

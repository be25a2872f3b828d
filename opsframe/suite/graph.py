"""Graph walks and lineage (H, C12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.operators import graph, lineage, reach
from opsframe.suite import query
from opsframe.suite.calendar import _KEYED, keyed


def _task_roots(f):
    """Tasks that others depend on and that depend on none."""
    return graph.roots_of(f.task_edges, "parent_task_id", "task_id").withColumnRenamed("node", "root")


def _bfs(edges: str, src: str, dst: str, roots: str, cap: int | None = None) -> str:
    """Level of first visit per (root, node), as a recursive query."""
    bound = f"AND w.level < {cap}" if cap is not None else ""
    return f"""walked(root, node, level) AS (
  SELECT root, root, 0 FROM ({roots}) r UNION
  SELECT w.root, e.{dst}, w.level + 1 FROM walked w JOIN ({edges}) e ON e.{src} = w.node WHERE TRUE {bound}),
nodes AS (SELECT root, node, min(level) AS level FROM walked GROUP BY root, node)"""


_T_ROOTS = "SELECT DISTINCT parent_task_id AS root FROM task_edges WHERE parent_task_id NOT IN (SELECT task_id FROM task_edges)"


@query("h01_descendants", f"""
WITH RECURSIVE {_bfs('SELECT * FROM task_edges', 'parent_task_id', 'task_id', _T_ROOTS, 20)}
SELECT n.root, CAST(n.level + 1 AS INTEGER) AS level, e.parent_task_id, e.task_id FROM nodes n JOIN task_edges e
ON e.parent_task_id = n.node WHERE n.level < 20
""")
def _(f):
    return graph.descendants(f.task_edges, _task_roots(f), 20, "parent_task_id", "task_id")


_T_LEAVES = "SELECT DISTINCT task_id AS root FROM task_edges WHERE task_id NOT IN (SELECT parent_task_id FROM task_edges)"


@query("h02_ancestors", f"""
WITH RECURSIVE {_bfs('SELECT * FROM task_edges', 'task_id', 'parent_task_id', _T_LEAVES, 3)}
SELECT n.root, CAST(n.level + 1 AS INTEGER) AS level, e.parent_task_id, e.task_id FROM nodes n JOIN task_edges e
ON e.task_id = n.node WHERE n.level < 3
""")
def _(f):
    leaves = graph.leaves_of(f.task_edges, "parent_task_id", "task_id").withColumnRenamed("node", "root")
    return graph.ancestors(f.task_edges, leaves, 3, "parent_task_id", "task_id")


# The lineage fixture is a chain of thousands of tables; the last stretch of it holds a cycle and has short walks.
_L_LAST = "SELECT max(input_table_id) - 20 AS root FROM lineage_edges WHERE input_table_id % 50 = 0"


def _last_tables(f):
    back = f.lineage_edges.where("input_table_id % 50 = 0")
    return back.agg((F.max("input_table_id") - 20).alias("root"))


_L_FIRST = "SELECT min(result_table_id) + 1 AS root FROM lineage_edges WHERE input_table_id > result_table_id"


def _first_tables(f):
    return f.lineage_edges.where("input_table_id > result_table_id").agg(
        (F.min("result_table_id") + 1).alias("root"))


_EDGES = "SELECT * FROM lineage_edges"


def _cyclic(edges: str, src: str, dst: str, roots: str) -> str:
    """Reached nodes by plain UNION, then levels by a bounded second recursion over reached nodes only."""
    return f"""reach(root, node) AS (SELECT root, root FROM ({roots}) r UNION
  SELECT w.root, e.{dst} FROM reach w JOIN ({edges}) e ON e.{src} = w.node)"""


@query("h03_find_cycles", f"""
WITH RECURSIVE {_bfs(_EDGES, 'input_table_id', 'result_table_id', _L_LAST, 120)},
again AS (SELECT DISTINCT a.root, b.node FROM nodes a JOIN lineage_edges e ON e.input_table_id = a.node
  JOIN nodes b ON b.root = a.root AND b.node = e.result_table_id WHERE a.level >= b.level)
SELECT a.root, e.input_table_id, e.result_table_id FROM again a JOIN lineage_edges e ON e.input_table_id = a.node
""")
def _(f):
    return graph.find_cycles(f.lineage_edges, _last_tables(f), "input_table_id", "result_table_id")


# All pairs of tables of which one leads to the other.
_ALL = """reach(root, node) AS (SELECT input_table_id, result_table_id FROM {edges} UNION
  SELECT w.root, e.result_table_id FROM reach w JOIN {edges} e ON e.input_table_id = w.node)"""


@query("h03_cyclic_edges", f"""
WITH RECURSIVE {_ALL.format(edges='lineage_edges')},
both_ways AS (SELECT a.root AS node, least(a.root, min(a.node)) AS component FROM reach a JOIN reach b ON a.root = b.node AND a.node = b.root GROUP BY a.root)
SELECT input_table_id, result_table_id, p.component FROM lineage_edges e JOIN both_ways p ON p.node = e.input_table_id
JOIN both_ways q ON q.node = e.result_table_id AND q.component = p.component
""")
def _(f):
    return reach.cyclic_edges(f.lineage_edges, "input_table_id", "result_table_id")


@query("h10_upstream_of_all", f"""
WITH RECURSIVE {_ALL.format(edges='layer_edges')},
met AS (SELECT node AS root, root AS node FROM reach UNION SELECT result_table_id, result_table_id FROM layer_edges)
SELECT root, input_table_id, result_table_id FROM met JOIN layer_edges ON result_table_id = node
""")
def _(f):
    return reach.closure_edges(f.layer_edges, "result_table_id", "input_table_id")


@query("h11_downstream_of_all", f"""
WITH RECURSIVE {_ALL.format(edges='layer_edges')},
met AS (SELECT root, node FROM reach UNION SELECT input_table_id, input_table_id FROM layer_edges)
SELECT root, input_table_id, result_table_id FROM met JOIN layer_edges ON input_table_id = node
""")
def _(f):
    return reach.closure_edges(f.layer_edges, "input_table_id", "result_table_id")


@query("h04_display_edges", f"""
SELECT job_key, parent_job_key FROM ({_KEYED}) e JOIN job_runs c USING (job_key)
WHERE left(right(e.job_key, 14), 8) = left(right(parent_job_key, 14), 8)
AND split_part(e.job_key, '_', 2) <> split_part(parent_job_key, '_', 2) AND flow_job_id = '0'
""")
def _(f):
    return graph.display_edges(keyed(f), f.job_runs)


@query("h05_nest", f"""
WITH RECURSIVE {_bfs('SELECT * FROM task_edges', 'parent_task_id', 'task_id', _T_ROOTS, 20)},
hung AS (SELECT n.root, n.node, n.level, min(e.parent_task_id) AS parent FROM nodes n JOIN task_edges e
  ON e.task_id = n.node JOIN nodes p ON p.root = n.root AND p.node = e.parent_task_id AND p.level = n.level - 1
  GROUP BY ALL),
tree(root, node, path) AS (SELECT root, root, CAST(root AS VARCHAR) FROM ({_T_ROOTS}) r
  UNION ALL SELECT h.root, h.node, concat(t.path, '>', h.node) FROM tree t JOIN hung h
  ON h.root = t.root AND h.parent = t.node)
SELECT h.root, h.node, h.parent, CAST(h.level AS INTEGER) AS level, path FROM hung h JOIN tree t
ON t.root = h.root AND t.node = h.node
""")
def _(f):
    levels = graph.descendants(f.task_edges, _task_roots(f), 20, "parent_task_id", "task_id")
    return graph.nest(levels, "parent_task_id", "task_id").withColumn("path", F.array_join("path", ">"))


@query("h05_child_lists", """
SELECT parent_task_id, string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY task_id) AS children FROM task_edges GROUP BY 1
""")
def _(f):
    rows = f.task_edges.withColumn("root", F.lit(0))
    return graph.child_lists(rows, "parent_task_id", "task_id").select(
        "parent_task_id", F.array_join("children", ",").alias("children"))


@query("h06_task_graph", f"""
WITH RECURSIVE {_bfs('SELECT * FROM task_edges', 'parent_task_id', 'task_id', _T_ROOTS, 6)},
down AS (SELECT n.root, n.level + 1 AS level, e.parent_task_id, e.task_id FROM nodes n JOIN task_edges e
  ON e.parent_task_id = n.node WHERE n.level < 6),
met AS (SELECT root, flow_id, min(level) AS level FROM (SELECT root, level, task_id AS flow_id FROM down
  UNION ALL SELECT root, 0, root FROM ({_T_ROOTS}) r) m GROUP BY ALL)
SELECT root, CAST(level AS INTEGER) AS level, parent_task_id, task_id, 'down' AS kind FROM down
UNION ALL SELECT root, CAST(level AS INTEGER), t.flow_id, t.task_id, 'member' FROM met JOIN tasks t
ON t.flow_id = met.flow_id AND t.flow_id > 0 AND t.is_deleted = 0
""")
def _(f):
    return graph.task_graph(f.tasks, f.task_edges, _task_roots(f), 6, "down")


_FLOW_EDGES = """SELECT e.task_id, e.parent_task_id FROM chain e JOIN tasks c ON c.task_id = e.task_id JOIN tasks p
ON p.task_id = e.parent_task_id AND p.flow_id = c.flow_id WHERE c.flow_id > 0 AND c.is_deleted = 0 AND p.is_deleted = 0"""


@query("h07_workflow_graph", f"""
WITH RECURSIVE chain AS (SELECT task_id, task_id - 1 AS parent_task_id FROM tasks WHERE task_id > 1),
{_bfs(_FLOW_EDGES, 'parent_task_id', 'task_id',
      f"SELECT task_id AS root FROM tasks WHERE flow_id > 0 AND is_deleted = 0 AND task_id NOT IN (SELECT task_id FROM ({_FLOW_EDGES}) x)", 20)}
SELECT t.flow_id, n.node AS task_id, CAST(min(n.level) AS INTEGER) AS level FROM nodes n JOIN tasks t ON t.task_id = n.node
GROUP BY ALL
""")
def _(f):
    chain = f.tasks.where("task_id > 1").select("task_id", (F.col("task_id") - 1).alias("parent_task_id"))
    return graph.workflow_graph(f.tasks, chain)


_SAME_DAY = f"""SELECT * FROM ({_KEYED}) k WHERE left(right(job_key, 14), 8) = left(right(parent_job_key, 14), 8)
AND split_part(job_key, '_', 2) <> split_part(parent_job_key, '_', 2)"""

_FIRST_OF_DAY = """SELECT min_by(job_key, id) AS root FROM job_runs GROUP BY CAST(cyc_ts AS DATE)"""


def _first_of_day(f):
    return f.job_runs.groupBy(F.col("cyc_ts").cast("date")).agg(F.min_by("job_key", "id").alias("root")).select("root")


@query("h08_restart_next", f"""
SELECT DISTINCT r.root, CAST(1 AS INTEGER) AS level, e.job_key, j.id, j.status FROM ({_FIRST_OF_DAY}) r
JOIN ({_SAME_DAY}) e ON e.parent_job_key = r.root JOIN job_runs j ON j.job_key = e.job_key
""")
def _(f):
    return graph.restart_closure(keyed(f), f.job_runs, _first_of_day(f), only_next=True).select(
        "root", "level", "job_key", "id", "status")


@query("h08_restart_closure", f"""
WITH RECURSIVE same AS ({_SAME_DAY}),
{_bfs('SELECT * FROM same', 'parent_job_key', 'job_key', _FIRST_OF_DAY)}
SELECT n.root, CAST(n.level AS INTEGER) AS level, n.node AS job_key, j.id, j.status FROM nodes n
JOIN job_runs j ON j.job_key = n.node WHERE level > 0
""")
def _(f):
    return graph.restart_closure(keyed(f), f.job_runs, _first_of_day(f)).select(
        "root", "level", "job_key", "id", "status")


@query("h09_same_day_descendants", f"""
WITH RECURSIVE same AS (SELECT s.* FROM ({_SAME_DAY}) s JOIN job_runs j ON j.job_key = s.job_key
  JOIN tasks t ON t.task_id = j.task_id AND t.is_deleted = 0),
{_bfs('SELECT * FROM same', 'parent_job_key', 'job_key', _FIRST_OF_DAY)}
SELECT root, CAST(level AS INTEGER) AS level, node AS job_key FROM nodes WHERE level > 0
""")
def _(f):
    return graph.same_day_descendants(keyed(f), f.job_runs, f.tasks, _first_of_day(f))


@query("h10_table_upstream", f"""
WITH RECURSIVE {_cyclic(_EDGES, 'result_table_id', 'input_table_id', _L_FIRST)}
SELECT r.root, e.input_table_id, e.result_table_id FROM reach r JOIN lineage_edges e ON e.result_table_id = r.node
""")
def _(f):
    return lineage.table_upstream(f.lineage_edges, _first_tables(f)).select(
        "root", "input_table_id", "result_table_id")


@query("h11_table_downstream", f"""
WITH RECURSIVE {_cyclic(_EDGES, 'input_table_id', 'result_table_id', _L_LAST)}
SELECT r.root, e.input_table_id, e.result_table_id FROM reach r JOIN lineage_edges e ON e.input_table_id = r.node
""")
def _(f):
    return lineage.table_downstream(f.lineage_edges, _last_tables(f)).select(
        "root", "input_table_id", "result_table_id")


# Column lineage: product -> type -> size -> brand, a shallow graph over all parts.
_COLS = """
SELECT p_partkey AS it, 'key' AS ic, 100000000 + p_size AS ot, p_type AS oc FROM part
UNION SELECT 100000000 + p_size, p_type, 200000000, p_brand FROM part
UNION SELECT 200000000, p_brand, 300000000, 'all' FROM part"""


def _column_graph(f):
    p = f.part

    def edge(a, b, c, d):
        return p.select(a.cast("long").alias("input_table_id"), b.alias("input_column_name"),
                        c.cast("long").alias("result_table_id"), d.alias("result_column_name"))

    size = F.col("p_size") + 100_000_000
    return edge(F.col("p_partkey"), F.lit("key"), size, F.col("p_type")).unionByName(
        edge(size, F.col("p_type"), F.lit(200_000_000), F.col("p_brand"))).unionByName(
        edge(F.lit(200_000_000), F.col("p_brand"), F.lit(300_000_000), F.lit("all"))).distinct()


@query("h12_column_upstream", f"""
WITH RECURSIVE c AS ({_COLS}), w(t, n) AS (SELECT 300000000, 'all' UNION
  SELECT c.it, c.ic FROM w JOIN c ON c.ot = w.t AND c.oc = w.n)
SELECT it AS input_table_id, ic AS input_column_name, ot AS result_table_id, oc AS result_column_name
FROM c JOIN w ON c.ot = w.t AND c.oc = w.n
""")
def _(f):
    edges = _column_graph(f)
    roots = edges.where("result_table_id = 300000000").select(
        F.col("result_table_id").alias("table_id"), F.col("result_column_name").alias("column_name")).distinct()
    return lineage.column_upstream(edges, roots).select(
        "input_table_id", "input_column_name", "result_table_id", "result_column_name")


@query("h12_column_downstream", f"""
WITH RECURSIVE c AS ({_COLS}), w(rt, rn, t, n) AS (SELECT DISTINCT it, ic, it, ic FROM c WHERE it >= 100000000
  AND it < 200000000 UNION SELECT w.rt, w.rn, c.ot, c.oc FROM w JOIN c ON c.it = w.t AND c.ic = w.n)
SELECT rt AS root_table_id, rn AS root_column_name, it AS input_table_id, ic AS input_column_name,
ot AS result_table_id, oc AS result_column_name FROM c JOIN w ON c.it = w.t AND c.ic = w.n
""")
def _(f):
    edges = _column_graph(f)
    roots = edges.where("input_table_id >= 100000000 AND input_table_id < 200000000").select(
        F.col("input_table_id").alias("table_id"), F.col("input_column_name").alias("column_name")).distinct()
    return lineage.column_downstream(edges, roots).drop("level")


@query("h13_lineage_columns", """
SELECT DISTINCT 'input' AS side, input_table_id AS table_id, input_column_name AS column_name FROM column_edges
UNION ALL SELECT DISTINCT 'result', result_table_id, result_column_name FROM column_edges
""")
def _(f):
    a, b = (lineage.lineage_columns(f.column_edges, s).select(F.lit(s).alias("side"), "table_id", "column_name")
            for s in ("input", "result"))
    return a.unionByName(b)


@query("h14_edge_keys", """
SELECT concat(input_table_id, '_', result_table_id) AS table_key, md5(concat(input_table_id, '.', input_column_name,
'_', result_table_id, '.', result_column_name)) AS column_key FROM column_edges
""")
def _(f):
    a, b = F.col("input_table_id"), F.col("result_table_id")
    return f.column_edges.select(
        lineage.table_edge_key(a, b).alias("table_key"),
        lineage.column_edge_key(a, F.col("input_column_name"), b, F.col("result_column_name")).alias("column_key"))


@query("h15_table_edges_from_sql", """
SELECT script_id, concat('ods.r', n_regionkey) AS input_table, CASE WHEN script_id % 2 = 0
THEN concat('dm.t', script_id) ELSE concat('dev.t', script_id) END AS result_table
FROM sql_texts JOIN nation ON n_nationkey = script_id
UNION ALL SELECT script_id, concat('dev.t', script_id + 100), concat('dm.t', script_id) FROM sql_texts
WHERE script_id % 2 = 0
""")
def _(f):
    return lineage.table_edges_from_sql(f.sql_texts, default_db="dev")


@query("h15_edges_of_scripts", """
WITH x AS (SELECT script_id, script_id % 5 AS k, CAST(script_id AS VARCHAR) AS i FROM sql_scripts)
SELECT script_id, concat('ods.a', i) AS input_table, concat('dm.', unnest(['x', 'y']), i) AS result_table FROM x WHERE k = 0
UNION ALL SELECT script_id, concat('ods.s', i), concat('dm.m', i) FROM x WHERE k = 1
UNION ALL SELECT script_id, unnest([concat('ods.b', i), 'dev.c']), concat('dm.v', i) FROM x WHERE k = 2
UNION ALL SELECT script_id, unnest([concat('ods.d', i), 'ods.e']), concat('dm.w', i) FROM x WHERE k = 3
UNION ALL SELECT script_id, unnest(['ods.f', 'ods.g']), concat('dm.n', i) FROM x WHERE k = 4
""")
def _(f):
    return lineage.table_edges_from_sql(f.sql_scripts, default_db="dev")


@query("h16_roots_and_leaves", """
SELECT DISTINCT 'root' AS kind, parent_task_id AS node FROM task_edges WHERE parent_task_id NOT IN
(SELECT task_id FROM task_edges) UNION ALL
SELECT DISTINCT 'leaf', task_id FROM task_edges WHERE task_id NOT IN (SELECT parent_task_id FROM task_edges)
""")
def _(f):
    a = graph.roots_of(f.task_edges, "parent_task_id", "task_id").select(F.lit("root").alias("kind"), "node")
    return a.unionByName(graph.leaves_of(f.task_edges, "parent_task_id", "task_id").select(
        F.lit("leaf").alias("kind"), "node"))


@query("c12_lineage_view", """
SELECT e.input_table_id, e.result_table_id, a.p_type AS input_db, a.p_name AS input_table, b.p_type AS result_db,
b.p_name AS result_table, n_name AS source_name FROM lineage_edges e JOIN part a ON a.p_partkey = e.input_table_id
JOIN part b ON b.p_partkey = e.result_table_id LEFT JOIN nation ON n_nationkey = a.p_size % 30
""")
def _(f):
    datasets = f.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("db_name"),
                             F.col("p_name").alias("table_name"), (F.col("p_size") % 30).alias("source_id"))
    sources = f.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("source_name"),
                              F.lit(1).alias("source_type"))
    return lineage.lineage_view(f.lineage_edges, datasets, sources).drop("source_id", "source_type")

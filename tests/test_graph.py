"""Walks with cycles, both strategies, and edges found in SQL."""

import pytest
from pyspark.sql import functions as F

from opsframe.operators import filters, graph, lineage


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (1, 5), (5, 6), (9, 9), (None, 2), (7, None)]
    return spark.createDataFrame(rows, "a int, b int")


def levels(df):
    return {(r["root"], r["node"]): r["level"] for r in df.collect()}


@pytest.mark.parametrize("small", [0, 1000])
def test_walk_ends_on_cycles(spark, edges, small):
    roots = spark.createDataFrame([(1,), (9,), (6,)], "root int")
    got = levels(graph.walk(edges, roots, "a", "b", broadcast_edges=small))
    assert got == {(1, 1): 0, (1, 2): 1, (1, 5): 1, (1, 3): 2, (1, 6): 2, (1, 4): 3, (9, 9): 0, (6, 6): 0}
    assert max(levels(graph.walk(edges, roots, "a", "b", 2, broadcast_edges=small)).values()) == 2


def test_hub_with_a_third_of_the_edges(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("a"), (F.col("id") + 1).alias("b"))
    roots = spark.createDataFrame([(0,)], "root long")
    small, large = (levels(graph.walk(rows, roots, "a", "b", 4, broadcast_edges=n)) for n in (10**6, 0))
    assert small == large and len(small) > 1000


def test_repeated_edges(spark, edges):
    roots = spark.createDataFrame([(1,)], "root int")
    got = {(r["a"], r["b"]) for r in graph.find_cycles(edges, roots, "a", "b").collect()}
    # node 1 is met again from 3, and node 5 from 4
    assert got == {(1, 2), (1, 5), (5, 6)}


def test_nest_paths(spark, edges):
    roots = spark.createDataFrame([(1,)], "root int")
    rows = graph.nest(graph.descendants(edges, roots, 20, "a", "b"), "a", "b").collect()
    assert {r["node"]: "/".join(r["path"]) for r in rows} == {
        2: "1/2", 5: "1/5", 3: "1/2/3", 6: "1/5/6", 4: "1/2/3/4"}


SQL = {
    "insert into test select * from test1": {("dev.test1", "dev.test")},
    "create table target (id int)": set(),
    "create table target as select * from target1": {("dev.target1", "dev.target")},
    "WITH c AS (SELECT * FROM a.x), d AS (SELECT * FROM c) INSERT OVERWRITE TABLE `b`.`y` SELECT * FROM d JOIN z ON 1=1":
        {("a.x", "b.y"), ("dev.z", "b.y")},
    "INSERT INTO t SELECT 'from fake; insert into no' FROM r1 q, r2 AS w, r3 -- from hidden\n WHERE 1=1":
        {("dev.r1", "dev.t"), ("dev.r2", "dev.t"), ("dev.r3", "dev.t")},
    "select 1 from nowhere; insert into t select * from (select * from s.inner_t) x /* from no */ left join u on 1=1":
        {("s.inner_t", "dev.t"), ("dev.u", "dev.t")},
    "CREATE TEMPORARY VIEW v AS SELECT * FROM q": set(),
    "from s1 a join s2 insert into t1 select a.x insert overwrite table `d2`.t2 select a.y where a.y > 'insert into no'":
        {(f"dev.{s}", t) for s in ("s1", "s2") for t in ("dev.t1", "d2.t2")},
    "merge into a.t as x using b.s as y on x.k = y.k when matched then delete": {("b.s", "a.t")},
    "merge into t using (select * from u join w using (k)) y on 1 = 1": {("dev.u", "dev.t"), ("dev.w", "dev.t")},
    "create view v (a, b) as select * from q": {("dev.q", "dev.v")},
    "create or replace materialized view mv as with c as (select * from q) select * from c join r": {("dev.q", "dev.mv"), ("dev.r", "dev.mv")},
    "with a as (with b as (select * from x.y) select * from b) insert into t select * from a": {("x.y", "dev.t")},
    "create table if not exists k stored as parquet as select * from m": {("dev.m", "dev.k")},
}


def test_edges_from_sql(spark):
    df = spark.createDataFrame(list(enumerate(SQL)), "id int, sql_text string")
    got = {}
    for r in lineage.table_edges_from_sql(df, default_db="dev").collect():
        got.setdefault(r["id"], set()).add((r["input_table"], r["result_table"]))
    assert got == {i: v for i, v in enumerate(SQL.values()) if v}


def test_long_script(spark):
    text = "insert into t select * from s where x in (" + ",".join(f"'v;{i}'" for i in range(50_000)) + "); "
    df = spark.createDataFrame([(1, text * 2 + "insert into u select * from t")], "id int, sql_text string")
    assert lineage.table_edges_from_sql(df, default_db="d").count() == 2


def test_walks_have_no_depth_cap(spark):
    chain = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    root = spark.createDataFrame([(0,)], "root long")
    assert [graph.descendants(chain, root, n, "a", "b").count() for n in (0, 1, 30, None)] == [0, 1, 30, 40]


def test_same_day_descendants_have_no_depth_cap(spark):
    keys = [f"cronJob_{k}_20240301000000" for k in range(41)]
    chain = spark.createDataFrame(list(zip(keys, keys[1:])), "parent_job_key string, job_key string")
    runs = spark.createDataFrame(list(enumerate(keys)), "task_id int, job_key string")
    tasks = spark.createDataFrame([(k, 0) for k in range(41)], "task_id int, is_deleted int")
    root = spark.createDataFrame([(keys[0],)], "root string")
    counts = [graph.same_day_descendants(chain, runs, tasks, root, *n).count() for n in ((), (None,), (10,), (None, True))]
    assert counts == [40, 40, 10, 1]


def test_pages_hold_all_rows_unless_a_size_is_given(spark):
    rows = spark.range(2500)
    assert [filters.page(rows, "id", number, size).count() for number, size in ((None, None), (3, 1000), (1, 20))] == [2500, 500, 20]
    with pytest.raises(TypeError):
        filters.page(rows)

"""What the physical plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from opsframe import suite
from opsframe.operators import filters, jobs, series

suite.load()
FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """An instance table on disk, so that pruning and pushdown can be seen."""
    path = str(tmp_path_factory.mktemp("jobs") / "t")
    spark.range(1000).select(
        F.col("id"), (F.col("id") % 9).alias("task_id"), (F.col("id") % 27).cast("int").alias("status"),
        F.lit(0).alias("type"), F.lit("20240101000000").alias("cyc_time"), F.lit("20231231000000").alias("business_date"),
        F.col("id").alias("exec_time"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("cyc_ts"),
        F.lit(None).cast("timestamp_ntz").alias("exec_start_time"),
        F.lit(None).cast("timestamp_ntz").alias("exec_end_time")).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(stored):
    p = plan(filters.filter_status(stored, [8, 7]).select("id"))
    assert re.search(r"PushedFilters: \[In\(status", p)
    assert "ReadSchema: struct<id:bigint,status:int>" in p
    p = plan(jobs.status_buckets(stored))
    assert "ReadSchema: struct<status:int>" in p
    assert p.count("Exchange") == 1 and "Join" not in p
    p = plan(jobs.top_errors(stored, __import__("datetime").date(2024, 2, 1)))
    assert "GreaterThanOrEqual(cyc_time,20240102000000)" in p and "TakeOrderedAndProject" in p


def test_pages_are_top_k(stored):
    assert "TakeOrderedAndProject" in plan(filters.page(stored, "exec_time", 3, 10))


def test_rank_limits_run_before_the_shuffle(stored):
    for df in (jobs.recent_runs(stored, n=20), jobs.recent_stats(stored, 3)):
        p = plan(df)
        assert p.index("WindowGroupLimit") < p.index("Exchange") or p.count("WindowGroupLimit") == 2
    samples = stored.select(F.create_map(F.lit("t"), F.col("task_id").cast("string")).alias("labels"),
                            F.col("id").alias("ts"), F.col("exec_time").cast("double").alias("value"))
    assert plan(series.agg_series(samples, "topk", 2)).count("WindowGroupLimit") == 2
    assert plan(series.irate(samples, 1000, 500)).count("WindowGroupLimit") == 2


# joins without keys: only against a side of exactly one row, or of the fixed stage list
ONE_ROW = {"b19_search_tasks", "c16_dict_lookup", "d33_fill_preview", "a13_sync_report", "f02_upsert", "f03_insert_new",
           "f04_replace", "a02_script_options"}
LOOPS = ("h0", "h10", "h11", "h12", "a", "j01_current_status_s", "j02", "j03", "j04", "j06", "j09", "m0", "g17", "g18", "g19")


@pytest.mark.parametrize("name", [n for n in suite.QUERIES if n not in ONE_ROW and not n.startswith(LOOPS)])
def test_no_join_without_keys_and_no_row_python(spark, name):
    p = plan(suite.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p

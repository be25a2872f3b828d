"""Hot-key splitting gives what the plain window gives."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from opsframe.operators import jobs as jobs_ops
from opsframe.operators import joins, series
from opsframe.plans import ordered
from opsframe.streaming import feeds


@pytest.fixture(scope="module")
def rows(spark):
    """9000 rows; a third of them belong to key 0, which has ties in ``t``; one key is null."""
    return spark.range(9000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 301 == 1, F.lit(None)).otherwise(F.col("id") % 50).alias("k"),
        ((F.col("id") * 7919) % 1000).alias("t"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"))


def same(a, b):
    cols = sorted(a.columns)
    left = sorted(map(repr, a.select(*cols).collect()))
    assert left == sorted(map(repr, b.select(*cols).collect()))
    assert left


def in_order():
    return Window.partitionBy("k").orderBy("t", "id")


def test_split_marks_only_hot_keys(rows):
    split = ordered.split_hot(rows, ["k"], ["t", "id"], 500)
    sizes = {(r["k"], r["_piece"]): r["count"] for r in split.groupBy("k", "_piece").count().collect()}
    hot = {k: n for k, n in sizes.items() if k[1] > 0}
    assert {k[0] for k in hot} == {0} and len(hot) >= 6
    assert max(hot.values()) < 1000
    assert ordered.split_hot(rows, ["k"], ["t", "id"], 5000) is None


def test_numbered(rows):
    plain = rows.withColumn("rn", F.row_number().over(in_order()).cast("long"))
    same(ordered.numbered(rows, ["k"], ["t", "id"], limit=300), plain)
    down = Window.partitionBy("k").orderBy(F.desc("t"), F.desc("id"))
    same(ordered.numbered(rows, ["k"], ["t", "id"], descending=True, limit=300),
         rows.withColumn("rn", F.row_number().over(down).cast("long")))


@pytest.mark.parametrize("following", [False, True])
def test_neighbour(rows, following):
    step = F.lead if following else F.lag
    plain = rows.withColumn("n", step(F.struct("id", "v")).over(in_order()))
    same(ordered.neighbour(rows, ["k"], ["t", "id"], ["id", "v"], "n", following, limit=300), plain)


@pytest.mark.parametrize("current", [False, True])
def test_carried(rows, current):
    run = in_order().rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    plain = rows.withColumn("c", F.last("v", ignorenulls=True).over(run))
    same(ordered.carried(rows, ["k"], ["t", "id"], F.col("v"), "c", current, limit=300), plain)


def test_running_sum(rows):
    plain = rows.withColumn("s", F.sum("id").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    same(ordered.running_sum(rows, ["k"], ["t", "id"], F.col("id"), "s", limit=300), plain)


def test_chunked_keeps_everything_in_order(rows):
    out = ordered.chunked(rows, ["k"], ["t", "id"], F.col("id"), 100, limit=300).collect()
    whole = {}
    for r in sorted(out, key=lambda r: (str(r["k"]), r["chunk"])):
        assert len(r["items"]) <= 100
        whole.setdefault(r["k"], []).extend(r["items"])
    want = {}
    for r in rows.orderBy("t", "id").collect():
        want.setdefault(r["k"], []).append(r["id"])
    assert whole == want


def test_timestamps_as_order(spark):
    rows = spark.range(2000).select("id", F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 13 % 2000).cast(
        "timestamp_ntz").alias("t"))
    plain = rows.withColumn("n", F.lag(F.struct("id")).over(in_order()))
    same(ordered.neighbour(rows, ["k"], ["t", "id"], ["id"], "n", limit=100), plain)


def _jobs(spark):
    return spark.range(3000).select(
        F.col("id"), F.concat(F.lit("j"), F.col("id").cast("string")).alias("job_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("task_id"), (F.col("id") % 27).alias("status"),
        (F.col("id") % 9).alias("version_id"), F.lit(0).alias("type"), F.lit(1).alias("app_type"),
        F.timestamp_seconds(F.col("id") * 37 % 5000).cast("timestamp_ntz").alias("cyc_ts"),
        F.lit("20240101000000").alias("cyc_time"), (F.col("id") % 2).alias("period_type"),
        F.when(F.col("id") % 3 == 1, "j3").otherwise("0").alias("flow_job_id"))


def test_operators_on_a_hot_task(spark):
    jobs = _jobs(spark)
    for build in (
            lambda n: joins.previous_run(jobs, limit=n), lambda n: joins.last_success_before(jobs, limit=n),
            lambda n: jobs_ops.neighbour_periods(jobs, False, 2, limit=n),
            lambda n: jobs_ops.neighbour_periods(jobs, True, 2, limit=n),
            lambda n: jobs_ops.group_frequent(jobs, 100, limit=n),
            lambda n: jobs_ops.nest_workflows(jobs, jobs, 64, limit=n)):
        same(build(200), build(10**9))


def test_feeds_on_a_hot_job(spark):
    reports = spark.range(3000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("job_id"),
        F.when(F.col("id") % 11 < 8, 15).otherwise(4).cast("int").alias("status"),
        F.timestamp_seconds(F.col("id") * 3).cast("timestamp_ntz").alias("ts"))
    same(feeds.debounce_not_found(reports, 4, 100, limit=200), feeds.debounce_not_found(reports, 4, 100, limit=10**9))
    same(feeds.live_profile(reports, "", gap="20 seconds", by=("job_id",), limit=200),
         feeds.live_profile(reports, "", gap="20 seconds", by=("job_id",), limit=10**9))


def test_quantile_of_a_hot_timestamp(spark):
    rows = spark.range(2000).select(
        F.create_map(F.lit("i"), F.col("id").cast("string")).alias("labels"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).cast("long").alias("ts"),
        (F.col("id") * 31 % 977).cast("double").alias("value"))
    got = series.agg_series(rows, "quantile", 0.37, limit=50).select("ts", F.round("value", 9).alias("value"))
    want = rows.groupBy("ts").agg(F.round(F.percentile("value", F.lit(0.37)), 9).alias("value"))
    same(got, want)


def test_many_hot_keys_on_text_and_date_orders(spark):
    """No limit on hot keys; any orderable type cuts pieces; ranges of keys are disjoint."""
    big = spark.range(480).select(
        F.concat(F.lit("k"), F.col("id") % 40).alias("k"), F.concat(F.lit("n"), F.lpad(F.col("id"), 7, "0")).alias("t"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 7).cast("int")).alias("d"), F.col("id"))
    sizes = ordered.split_hot(big, ["k"], ["t"], 10).groupBy("k", "_piece").count()
    assert sizes.where("_piece = 0").count() == 0 and sizes.agg(F.max("count")).first()[0] <= 20
    for order in (["t"], ["d", "id"]):
        w = Window.partitionBy("k").orderBy(*order)
        same(ordered.numbered(big, ["k"], order, limit=10), big.withColumn("rn", F.row_number().over(w).cast("long")))
        same(ordered.neighbour(big, ["k"], order, ["id"], "n", limit=10), big.withColumn("n", F.lag(F.struct("id")).over(w)))


def test_one_key_with_ties_all_through(spark):
    ties = spark.range(5000).select(F.lit(1).alias("k"), F.lit("same").alias("t"), F.struct(F.lit(3).alias("a")).alias("s"), "id")
    sizes = ordered.split_hot(ties, ["k"], ["t", "s"], 500).groupBy("_piece").count()
    assert sizes.agg(F.max("count"), F.sum("count")).first()[1] == 5000 and sizes.agg(F.max("count")).first()[0] <= 1000
    got = ordered.numbered(ties, ["k"], ["t", "s"], limit=500)
    assert sorted(r.rn for r in got.select("rn").collect()) == list(range(1, 5001))

"""Scripts, sync jobs and their limits."""

import pytest
from pyspark.sql import functions as F

from opsframe.operators import series
from opsframe.sources import registry, script, sync


def test_split_statements():
    text = "a ';' b;\n;  ; c \"x;'y\" ; d 'it\\'s;' ; e"
    assert script.split_statements(text) == ["a ';' b", "c \"x;'y\"", "d 'it\\'s;'", "e"]
    assert script.split_statements("") == []
    assert script.split_statements("select 'x\"y'; select 2") == ["select 'x\"y'", "select 2"]


def test_script_stops_at_first_error(spark):
    with pytest.raises(script.ScriptError) as e:
        script.run_script(spark, "CREATE OR REPLACE TEMPORARY VIEW s1 AS SELECT 1 AS x; SELECT * FROM missing_t; "
                                 "CREATE OR REPLACE TEMPORARY VIEW s2 AS SELECT 1 AS x")
    assert [s for _, _, s in e.value.result.report] == ["done", "failed"]
    assert not spark.catalog.tableExists("s2")
    assert e.value.result.report_df(spark).count() == 2


def test_parameterised_script(spark):
    sql = "SELECT ${bdp.system.bizdate} AS a, ${dd} AS b, '${bdp.system.runtime}' AS c"
    params = [(0, "bdp.system.bizdate", "yyyyMMdd-1"), (1, "dd", "1234"),
              (0, "bdp.system.runtime", "${bdp.system.currenttime}")]
    row = script.run_sql_job(spark, sql, params, "20201116000000", "20201116080000").last.first()
    assert tuple(row) == (20201115, 1234, "20201116080000")
    text = script.render_script(spark, "use dev2; SELECT ${dd}, ${other}", params, "20201116000000", "20201116080000")
    assert text == "use dev2; SELECT 1234, ${other}"


def test_database_with_location(spark, tmp_path):
    script.run_script(spark, "CREATE TABLE t USING parquet AS SELECT 3 AS x", database="store1",
                      location=str(tmp_path / "store1"))
    assert spark.catalog.currentDatabase() == "default"
    assert script.query(spark, "SELECT x FROM t", "store1").first()["x"] == 3
    assert script.query(spark, "  ") is None
    assert [tuple(r) for r in script.list_columns(spark, "store1.t").collect()] == [("x", "int", "")]
    spark.sql("DROP DATABASE store1 CASCADE")


def test_partition_spec():
    assert sync.partition_spec("pt='a'/ds=\"b\"") == {"pt": "a", "ds": "b"}
    assert sync.partition_spec("pt=2020/04") == {"pt": "2020/04"}
    assert sync.partition_spec("pt=1") == {"pt": "1"}


def test_write_partition_of_a_table(spark):
    spark.sql("DROP TABLE IF EXISTS parted")
    spark.sql("CREATE TABLE parted (x INT, pt STRING) USING parquet PARTITIONED BY (pt)")
    df = spark.range(3).select(F.col("id").cast("int").alias("x"))
    sync.write_partition(df, "parted", "pt='a'")
    sync.write_partition(df, "parted", "pt='b'")
    sync.write_partition(df.limit(1), "parted", "pt='a'")
    got = {r["pt"]: r["n"] for r in spark.table("parted").groupBy("pt").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 1, "b": 3}
    spark.sql("DROP TABLE parted")


def _job(target, **setting):
    return {"content": [{"reader": {"customSql": "SELECT * FROM raw_rows"}, "writer": {
        "path": target, "column": [{"name": "n", "index": 1, "type": "NUMBER"}]}}], "setting": setting}


def test_error_limits_publish_nothing(spark, tmp_path):
    spark.range(100).select(
        "id", F.when(F.col("id") % 10 == 0, "x").otherwise(F.col("id").cast("string")).alias("v")
    ).createOrReplaceTempView("raw_rows")
    target = str(tmp_path / "out")
    for limit in ({"record": 9}, {"percentage": 9.9}):
        with pytest.raises(sync.ErrorLimitExceeded):
            sync.sync(spark, _job(target, errorLimit=limit))
        assert not (tmp_path / "out").exists()
    seen = sync.sync(spark, _job(target, errorLimit={"record": 10, "percentage": 0.0}))
    assert (seen["numRead"], seen["numWrite"], seen["nErrors"]) == (100, 90, 10)
    assert spark.read.parquet(target).count() == 90
    # 0 means no limit of that kind
    sync.sync(spark, _job(str(tmp_path / "out2"), errorLimit={"record": 0, "percentage": 0.0}))


def test_start_location(spark):
    rows = [(1, 1, 5, "20240101000000", "10"), (1, 2, 8, "20240102000000", "20"), (1, 3, 5, "20240105000000", "30")]
    h = spark.createDataFrame(rows, "task_id int, id int, status int, cyc_time string, end_location string")
    assert sync.start_location(h, 1, "20240103000000") == "10"
    assert sync.start_location(h, 2, "20240103000000") is None
    assert sync.start_location(h.withColumn("end_location", F.lit("0")), 1, "20240103000000") is None


def test_increment_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "src")
    spark.range(10).write.parquet(path)
    job = sync.SyncJob({"path": path, "increColumn": "id", "startLocation": "5"}, {}, {})
    df = sync.read_rows(spark, job)
    assert df.count() == 4
    assert "GreaterThan(id,5)" in df._jdf.queryExecution().executedPlan().toString()


def test_unknown_sources():
    with pytest.raises(registry.UnsupportedSource, match="REDIS"):
        registry.read_source(None, 12, {})
    with pytest.raises(registry.UnsupportedSource):
        registry.read_jdbc(None, "nodb", "x")


def test_increments_add_to_one_target(spark, tmp_path):
    spark.range(10).createOrReplaceTempView("inc_src")
    target = str(tmp_path / "inc")
    schema = "task_id long, id long, status int, cyc_time string, end_location string"
    history = spark.createDataFrame([], schema)
    for top in (6, 10):
        job = {"content": [{"reader": {"customSql": f"SELECT id FROM inc_src WHERE id < {top}", "increColumn": "id"},
                            "writer": {"path": target, "column": [{"name": "id", "index": 0, "type": "bigint"}]}}]}
        seen = sync.sync_incremental(spark, job, history, 1, "20240103000000")
        history = spark.createDataFrame([(1, 1, 5, "20240102000000", str(seen["endLocation"]))], schema)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == list(range(10))
    job["content"][0]["writer"]["writeMode"] = "overwrite"
    with pytest.raises(ValueError):
        sync.sync_incremental(spark, job, history, 1, "20240103000000")


def _stream_job(base, **setting):
    return {"content": [{
        "reader": {"path": f"{base}/in", "column": [{"name": "id"}, {"name": "amount"}]},
        "writer": {"path": f"{base}/out", "column": [{"name": "id", "type": "bigint"}, {"name": "amount", "type": "bigint"}]}}],
        "setting": {"dirty": {"path": f"{base}/dirty"}, **setting}}


def _deliver(spark, base, k):
    spark.range(100 * k, 100 * k + 100).selectExpr("id", "if(id % 10 = 3, 'bad', cast(id AS string)) AS amount").coalesce(1).write.mode(
        "append").parquet(f"{base}/in")


@pytest.mark.parametrize("cut", ["before the ledger", "before publishing", "after publishing"])
def test_restorable_sync_survives_a_cut_off_batch(spark, tmp_path, monkeypatch, cut):
    """Three batches, the second is cut off and comes again: same rows and counters as one batch sync."""
    base, schema = str(tmp_path), "id long, amount string"
    job = _stream_job(base)

    def run():
        sync.sync_stream(spark, job, f"{base}/state", schema).awaitTermination()

    _deliver(spark, base, 0)
    run()
    _deliver(spark, base, 1)
    name = {"before the ledger": "counters", "before publishing": "check_limits", "after publishing": "check_limits"}[cut]
    if cut == "after publishing":  # the batch is complete, only Spark's own note of it is missing
        run()
        for p in (tmp_path / "state" / "commits").glob("*1*"):
            p.unlink()
    else:
        with monkeypatch.context() as m:
            m.setattr(sync, name, lambda *a: 1 / 0)
            with pytest.raises(Exception, match="division"):
                run()
    run()
    _deliver(spark, base, 2)
    run()
    rows = sorted(r["id"] for r in spark.read.parquet(f"{base}/out").collect())
    assert rows == [i for i in range(300) if i % 10 != 3]
    report = sync.stream_report(spark, f"{base}/state").first().asDict()
    assert report == {"numRead": 300, "numWrite": 270, "nErrors": 30, "conversionErrors": 30, "nullErrors": 0, "otherErrors": 0}
    assert spark.read.parquet(f"{base}/dirty").count() == 30
    assert not list((tmp_path / "state" / "staging").glob("*"))


def test_restorable_sync_counts_errors_over_its_batches(spark, tmp_path):
    base, schema = str(tmp_path), "id long, amount string"
    for k in range(2):
        _deliver(spark, base, k)
        if k:
            with pytest.raises(Exception, match="20 failed rows, 15 allowed"):
                sync.sync_stream(spark, _stream_job(base, errorLimit={"record": 15}), f"{base}/state", schema).awaitTermination()
        else:
            sync.sync_stream(spark, _stream_job(base, errorLimit={"record": 15}), f"{base}/state", schema).awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == 90  # nothing of the second batch
    sync.sync_stream(spark, _stream_job(base, errorLimit={"record": 20}), f"{base}/state", schema).awaitTermination()
    assert spark.read.parquet(f"{base}/out").count() == 180


def test_locations_of_many_runs_join_in_linear_rows(spark):
    """Runs of a job meet the samples of their own slots only."""
    runs = spark.range(2_000).selectExpr(
        "id", "7L AS job_id", "timestamp_seconds(1700000000 + id * 600) AS exec_start_time", "timestamp_seconds(1700000000 + id * 600 + 500) AS exec_end_time")
    points = spark.range(40_000).selectExpr(
        "'endLocation' AS metric", "map('job_id', '7') AS labels", "(1700000000 + id * 30) * 1000L AS ts", "double(id) AS value")
    got = {r["id"]: r["location"] for r in series.last_location(points, runs).collect()}
    assert got == {k: (k * 600 + 560) // 30 for k in range(2_000)}

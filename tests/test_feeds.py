"""Streams over several micro-batches against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from opsframe.fixtures import Fixtures
from opsframe.streaming import feeds
from opsframe.suite.feeds import _fed


def _reports(spark, n=600):
    return spark.range(n).select(
        F.col("id").alias("event_id"), (F.col("id") % 7).alias("job_id"),
        F.when(F.col("id") % 70 < 55, 15).when(F.col("id") % 70 == 69, 8).otherwise(4).cast("int").alias("status"),
        (F.col("id") % 2).cast("int").alias("compute_type"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 10).alias("ts"))


def _files(spark, df, folder, parts):
    """One file per micro-batch, in event order."""
    size = df.agg(F.max("event_id")).first()[0] // parts + 1
    for i in range(parts):
        df.where((F.col("event_id") >= i * size) & (F.col("event_id") < (i + 1) * size)).coalesce(1).write.mode(
            "append").parquet(folder)


def _stream(spark, df, folder):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_debounce_carries_runs_over_batches(spark, tmp_path):
    df = _reports(spark)
    _files(spark, df, str(tmp_path / "in"), 5)
    out = str(tmp_path / "out")
    feeds.run_to_files(_stream(spark, df, str(tmp_path / "in")).select("event_id", "job_id", "status", "ts"), out,
                       str(tmp_path / "cp"), sink=feeds.debounce_sink(out, 6, 10_000))
    got = spark.read.parquet(f"{out}/rows").select("event_id", "status")
    want = feeds.debounce_not_found(df.select("event_id", "job_id", "status", "ts"), 6, 10_000).select("event_id", "status")
    assert want.where("status = 8 AND event_id % 70 <> 69").count() > 50
    assert _rows(got) == _rows(want)


def test_current_status_over_batches(spark, tmp_path):
    df = _reports(spark).withColumn("status", (F.col("event_id") * 5 % 27).cast("int"))
    _files(spark, df, str(tmp_path / "in"), 4)
    out = str(tmp_path / "out")
    feeds.run_to_files(feeds.current_status(_stream(spark, df, str(tmp_path / "in"))), out, str(tmp_path / "cp"), "update")
    assert len(list((tmp_path / "out").glob("batch=*"))) == 4
    last = feeds.read_latest(spark, out, ["job_id"])
    assert _rows(last.select("job_id", "status")) == _rows(feeds.current_status(df).select("job_id", "status"))


def test_retention_over_batches(spark, tmp_path):
    df = spark.range(200).select(
        F.col("id").alias("event_id"), (F.col("id") % 3).alias("task_id"),
        F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("task_engine_id"), F.col("id").alias("checkpoint_id"),
        F.lit("p").alias("checkpoint_savepath"))
    _files(spark, df, str(tmp_path / "in"), 6)
    out = str(tmp_path / "out")
    feeds.run_to_files(_stream(spark, df, str(tmp_path / "in")), out, str(tmp_path / "cp"), sink=feeds.retention_sink(out, 5))
    # a repeated last batch changes nothing
    before = _rows(feeds.read_retained(spark, out))
    last = spark.read.parquet(f"{out}/rows")
    number = last.agg(F.max("batch")).first()[0]
    again = spark.createDataFrame(last.where(F.col("batch") == number).drop("batch").collect(), last.drop("batch").schema)
    assert all(len(g) <= 2 for g in feeds._generations(spark, out).values())
    feeds.retention_sink(out, 5)(again, number)
    assert _rows(feeds.read_retained(spark, out)) == before
    kept = {}
    for r in feeds.read_retained(spark, out).collect():
        kept.setdefault(r["task_engine_id"], []).append(r["checkpoint_id"])
    assert {k: sorted(v) for k, v in kept.items()} == {
        f"e{k}": [i for i in range(200) if i % 3 == k][-5:] for k in range(3)}


def test_retention_reads_no_history(spark, tmp_path):
    """What a batch reads of the state stays the same over twenty batches."""
    out, sizes = str(tmp_path / "out"), []
    sink = feeds.retention_sink(out, 4)
    for k in range(20):
        batch = spark.range(40).select(
            (F.col("id") % 8).alias("task_id"), F.concat(F.lit("e"), F.col("id") % 8).alias("task_engine_id"),
            (F.col("id") + 40 * k).alias("checkpoint_id"), F.lit("path").alias("checkpoint_savepath"))
        sink(batch, k)
        state = [p for p in (tmp_path / "out" / "kept").rglob("*.parquet")]
        sizes.append((len({p.parent for p in state}), spark.read.schema(feeds._KEPT).parquet(*map(str, state)).count()))
    assert sizes[1:] == [sizes[1]] * 19
    assert {r["checkpoint_id"] for r in feeds.read_retained(spark, out).collect()} == set(range(800 - 32, 800))
    gone = spark.read.parquet(f"{out}/gone")
    assert gone.count() == 800 - 32 and gone.select("checkpoint_id").distinct().count() == 800 - 32


def test_deliveries_are_small_files(spark, tmp_path):
    """Rows of one file come in files that a stream can spread over its tasks, and all of them come."""
    spark.range(0, 120_000, 1, 1).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 1000).cast("timestamp_ntz").alias(
            "ts")).write.parquet(str(tmp_path / "events.parquet"))
    out = _fed(Fixtures(spark, str(tmp_path)), lambda events: events.select("event_id"), parts=2)
    sizes = [r["count"] for r in spark.read.parquet(f"{out[:-4]}/in").groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 50_000 and sum(sizes) == 120_000
    got = spark.read.parquet(out)
    assert got.count() == got.select("event_id").distinct().count() == 120_000


def test_retention_of_repeated_reports(spark, tmp_path):
    """A checkpoint reported twice is kept once or gone once; the step in between leaves nothing behind."""
    out = str(tmp_path / "out")
    for k in range(2):
        batch = spark.range(60).select(
            F.lit(1).cast("long").alias("task_id"), F.lit("e").alias("task_engine_id"), (F.col("id") % 30 + 30 * k).alias("checkpoint_id"),
            F.lit("path").alias("checkpoint_savepath"))
        feeds.retention_sink(out, 5)(batch, k)
    assert sorted(r["checkpoint_id"] for r in feeds.read_retained(spark, out).collect()) == list(range(55, 60))
    assert sorted(r["checkpoint_id"] for r in spark.read.parquet(f"{out}/gone").collect()) == list(range(55))
    assert spark.read.parquet(f"{out}/rows").count() == 120
    assert not list((tmp_path / "out" / "known").glob("*"))


def _silences(df, timeout_s, mark):
    """(job_id, since) by hand, as of the watermark."""
    jobs = {}
    for r in sorted(df.collect(), key=lambda r: (r["ts"], r["event_id"])):
        if r["ts"] <= mark:
            jobs.setdefault(r["job_id"], []).append((r["ts"], r["status"]))
    out = []
    for job, rows in jobs.items():
        for (ts, status), (following, _) in zip(rows, [*rows[1:], (mark, None)]):
            if (following - ts).total_seconds() >= timeout_s and status not in (5, 7, 8, 9, 12, 13, 18, 21, 24, 26):
                out.append((job, ts))
    return sorted(out)


def test_silent_jobs_on_a_stream_with_restarts(spark, tmp_path):
    """Deliveries overlap in time, a restart lies between them, timers fire for jobs that send nothing more."""
    df = _reports(spark).where("job_id <> 3 OR event_id < 200").where("job_id <> 4 OR event_id % 300 < 100").withColumn(
        "status", F.when((F.col("job_id") == 5) & (F.col("event_id") > 400), 5).otherwise(4)).where("job_id <> 5 OR event_id < 450")
    out, folder, late = str(tmp_path / "out"), str(tmp_path / "in"), 0
    for k in range(4):  # neighbours of ten go to different deliveries around the borders
        share = F.floor((F.col("event_id") + F.col("event_id") % 3 * 10) / 155).cast("int")
        df.where(share == k).coalesce(1).write.mode("append").parquet(folder)
        late += feeds.run_to_files(feeds.silent_jobs_stream(_stream(spark, df, folder), 600, "10 minutes"), out, str(tmp_path / "cp"), timers=True)
    mark = df.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    want = _silences(df, 600, mark)
    assert late == 0 and {j for j, _ in want} == {3, 4}
    rows = spark.read.parquet(out)
    assert sorted((r["job_id"], r["since"]) for r in rows.collect()) == want
    assert {r["status"] for r in rows.collect()} == {8}
    # a silence is known from the other jobs' reports alone, before the last delivery
    assert rows.where("job_id = 3").agg(F.max("batch")).first()[0] < rows.agg(F.max("batch")).first()[0]


def test_reports_behind_the_watermark_are_counted(spark, tmp_path):
    df, folder = _reports(spark, 200).withColumn("status", F.lit(4)), str(tmp_path / "in")
    counts = []
    for part in ("event_id >= 50", "event_id < 50"):
        df.where(part).coalesce(1).write.mode("append").parquet(folder)
        counts.append(feeds.run_to_files(
            feeds.silent_jobs_stream(_stream(spark, df, folder), 6000, "1 minute"), str(tmp_path / "out"), str(tmp_path / "cp"), timers=True))
    assert counts == [0, 50]

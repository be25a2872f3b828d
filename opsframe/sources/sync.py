"""Table sync jobs: typed copies with dirty rows, error limits, incremental and restorable loads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from opsframe.dims import SOURCE_TYPE, STATUS
from opsframe.operators.series import last_location
from opsframe.plans.storage import drop, scratch_dir
from opsframe.sources.registry import read_files, read_source

# Names of column types used in sync documents -> Spark types.
_TYPES = {
    "varchar2": "string", "varchar": "string", "char": "string", "nvarchar": "string", "text": "string",
    "number": "decimal(38,10)", "numeric": "decimal(38,10)", "integer": "int", "tinyint": "tinyint", "long": "bigint",
    "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz",
}


class ErrorLimitExceeded(RuntimeError):
    """More rows failed than the job allows; nothing was published."""


def spark_type(name: str) -> str:
    return _TYPES.get(name.lower(), name.lower())


@dataclass
class SyncJob:
    """The parts of a sync document that say what is copied."""

    reader: dict
    writer: dict
    setting: dict

    @classmethod
    def parse(cls, document: str | Mapping) -> SyncJob:
        doc = json.loads(document) if isinstance(document, str) else document
        job = doc.get("job", doc)
        content = job["content"][0]
        return cls(dict(content["reader"].get("parameter", content["reader"])),
                   dict(content["writer"].get("parameter", content["writer"])), dict(job.get("setting", {})))

    @property
    def restorable(self) -> bool:
        return str(self.setting.get("restore", {}).get("isRestore", False)).lower() == "true"

    @property
    def channel(self) -> int:
        return int(self.setting.get("speed", {}).get("channel", 1) or 1)

    @property
    def limits(self) -> tuple[float, float]:
        limit = self.setting.get("errorLimit", {})
        return float(limit.get("record", 0) or 0), float(limit.get("percentage", 0) or 0)

    def without_increment(self) -> SyncJob:
        reader = {k: v for k, v in self.reader.items() if k not in ("increColumn", "startLocation")}
        return SyncJob(reader, self.writer, self.setting)


def read_rows(spark: SparkSession, job: SyncJob) -> DataFrame:
    """Reader columns in their order; a custom query wins over a table, increments start after their location."""
    p = {**job.reader, "channel": job.channel}
    source = p.get("type")
    if p.get("customSql") and source is None:
        df = spark.sql(p["customSql"])
    elif source is not None:
        df = read_source(spark, int(source), p)
    elif "path" in p:
        df = read_files(spark, p["path"], p.get("fileType", "parquet"), p.get("schema"), p.get("fieldDelimiter", ","),
                        p.get("encoding", "UTF-8"))
    else:
        df = read_source(spark, SOURCE_TYPE["HIVE"], p)
    column, start = p.get("increColumn"), p.get("startLocation")
    if column and start is not None:
        # typed literal on the bare column, so that the filter reaches the scan
        df = df.where(F.col(column) > F.lit(start).cast(dict(df.dtypes)[column]))
    columns = [c["name"] for c in p.get("column", [])]
    return df.select(*columns) if columns else df


def _targets(job: SyncJob, df: DataFrame) -> list[tuple[str, str, str]]:
    """(reader column, writer column, type): the writer names the value at position ``index``."""
    out = []
    for position, c in enumerate(job.writer.get("column", [])):
        out.append((df.columns[int(c.get("index", position))], c["name"], spark_type(c["type"])))
    return out or [(n, n, t) for n, t in df.dtypes]


def _cast(source: str, kind: str) -> Column:
    return F.col(source).try_cast(kind)


def split_dirty(df: DataFrame, targets: Sequence[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(good, dirty): rows whose values all convert, typed; and the others as text with the columns at fault."""
    flagged = flag_dirty(df, targets)
    good = flagged.where(F.size("_faults") == 0).select(*[n for _, n, _ in targets])
    dirty = flagged.where(F.size("_faults") > 0).select(F.col("_row").alias("row"), F.col("_faults").alias("faults"))
    return good, dirty


def flag_dirty(df: DataFrame, targets: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Typed columns plus ``_faults`` (columns that lost their value) and ``_row`` (the source row of a faulty one)."""
    faults = F.filter(F.array(*[
        F.when(F.col(s).isNotNull() & _cast(s, k).isNull(), F.lit(n)) for s, n, k in targets]),
        lambda x: x.isNotNull())
    raw = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return df.select(*[_cast(s, k).alias(n) for s, n, k in targets], faults.alias("_faults"),
                     F.when(F.size(faults) > 0, raw).alias("_row"))


def counters(required: Sequence[str] = ()) -> list[Column]:
    """Read, written and failed rows by kind, over flagged rows."""
    conversion = F.size("_faults") > 0
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    missing = missing & ~conversion
    return [
        F.count(F.lit(1)).alias("numRead"), F.count_if(~conversion & ~missing).alias("numWrite"),
        F.count_if(conversion | missing).alias("nErrors"), F.count_if(conversion).alias("conversionErrors"),
        F.count_if(missing).alias("nullErrors"), F.lit(0).cast("long").alias("otherErrors"),
    ]


def sync_report(df: DataFrame, targets: Sequence[tuple[str, str, str]], required: Sequence[str] = (),
                key: Sequence[str] = ()) -> DataFrame:
    """One row of counters. Duplicates by ``key`` come from counts per key, combined before the shuffle."""
    flagged = flag_dirty(df, targets)
    base = flagged.agg(*counters(required))
    if not key:
        return base.withColumn("duplicateErrors", F.lit(0).cast("long"))
    extra = flagged.where(F.size("_faults") == 0).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicateErrors"))
    # one row by construction
    return base.crossJoin(F.broadcast(extra))


def check_limits(seen: Mapping[str, int], record: float, percentage: float) -> None:
    """0 or nothing means no limit of that kind."""
    errors, read = seen["nErrors"], seen["numRead"]
    if record and errors > record:
        raise ErrorLimitExceeded(f"{errors} failed rows, {record:g} allowed")
    if percentage and read and errors * 100.0 / read > percentage:
        raise ErrorLimitExceeded(f"{errors * 100.0 / read:.2f}% failed rows, {percentage:g}% allowed")


def partition_spec(text: str) -> dict[str, str]:
    """``pt='a'/ds='b'``; one '=' and one '/' means that the slash belongs to the value."""
    parts = [text] if text.count("/") == 1 and text.count("=") == 1 else text.split("/")
    out = {}
    for part in parts:
        name, _, value = part.partition("=")
        value = value.strip()
        value = value[1:] if value[:1] in "'\"" and value else value
        out[name.strip()] = value[:-1] if value[-1:] in "'\"" and value else value
    return out


def write_files(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", delimiter: str = ",",
                encoding: str = "UTF-8", partition: Mapping[str, str] | None = None) -> None:
    """Writes files; with a partition only that partition is replaced."""
    kind = kind.lower()
    if partition:
        df = df.withColumns({k: F.lit(v) for k, v in partition.items()})
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition:
        writer = writer.partitionBy(*partition)
    if kind in ("text", "csv"):
        writer.option("sep", delimiter).option("encoding", encoding).csv(path)
    else:
        writer.format(kind).save(path)


def write_partition(df: DataFrame, table: str, spec: str, mode: str = "overwrite") -> None:
    """Adds the partition if it is missing and writes the rows there; other partitions stay."""
    values = partition_spec(spec)
    text = ", ".join(f"{k}='" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for k, v in values.items())
    spark = df.sparkSession
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({text})")
    columns = [c for c in spark.table(table).columns if c not in values]
    verb = "OVERWRITE" if mode == "overwrite" else "INTO"
    spark.sql(f"INSERT {verb} TABLE {table} PARTITION ({text}) SELECT * FROM {{rows}}", rows=df.select(*columns))


def _publish(good: DataFrame, job: SyncJob) -> None:
    w = job.writer
    mode = {"append": "append", "insert": "append"}.get(str(w.get("writeMode", "overwrite")).lower(), "overwrite")
    if "path" in w:
        spec = partition_spec(w["partition"]) if w.get("partition") else None
        write_files(good, w["path"], w.get("fileType", "parquet"), mode, w.get("fieldDelimiter", ","),
                    w.get("encoding", "UTF-8"), spec)
    elif w.get("partition"):
        write_partition(good, w["table"], w["partition"], mode)
    else:
        good.write.mode(mode).saveAsTable(w["table"])


def sync(spark: SparkSession, document: str | Mapping | SyncJob, mode: str = "normal",
         error_limit: tuple[float, float] | None = None, required: Sequence[str] = (), run: str | None = None,
         task_name: str = "sync", dirty_path: str | None = None) -> dict[str, object]:
    """Runs a sync job and returns its counters and, for an increment column, ``endLocation``.

    The source is evaluated once, in as many tasks as its size asks for; ``channel`` bounds the connections to a database and nothing
    else. Without limits and dirty rows it goes straight
    to the target; otherwise to staging files split by the dirty flag, whose
    counters are checked before anything is published.
    """
    job = document if isinstance(document, SyncJob) else SyncJob.parse(document)
    if mode == "backfill":
        job = job.without_increment()
    rows = read_rows(spark, job)
    targets = _targets(job, rows)
    flagged = flag_dirty(rows, targets)
    measures = counters(required)
    increment = job.reader.get("increColumn")
    name_of = {s: n for s, n, _ in targets}
    if increment:
        measures = [*measures, F.max(name_of[increment]).alias("endLocation")]
    seen = Observation()
    observed = flagged.observe(seen, *measures)
    bad = F.size("_faults") > 0
    for c in required:
        bad = bad | F.col(c).isNull()
    names = [n for _, n, _ in targets]
    record, percentage = error_limit or job.limits
    dirty_path = dirty_path or job.setting.get("dirty", {}).get("path")
    if not (record or percentage or dirty_path):
        _publish(observed.where(~bad).select(*names), job)
        return dict(seen.get)
    staging = f"{scratch_dir(spark).rstrip('/')}/sync-{uuid.uuid4().hex}"
    observed.withColumn("_bad", bad).write.partitionBy("_bad").parquet(staging)
    try:
        check_limits(seen.get, record, percentage)
    except ErrorLimitExceeded:
        drop(spark, staging)
        raise
    staged = spark.read.schema(flagged.withColumn("_bad", F.lit(True)).schema).parquet(staging)
    if dirty_path:
        staged.where("_bad").select(F.col("_row").alias("row"), F.col("_faults").alias("faults")).withColumns(
            {"task_name": F.lit(task_name), "time": F.lit(run or uuid.uuid4().hex)}).write.mode("append").partitionBy(
            "task_name", "time").parquet(dirty_path)
    _publish(staged.where("NOT _bad").select(*names), job)
    drop(spark, staging)
    return dict(seen.get)


def start_location(history: DataFrame, task_id: object, cyc_time: str) -> str | None:
    """End location of the last FINISHED run of a task before a cycle; empty and 0 mean none.

    ``history`` has (task_id, id, status, cyc_time, end_location).
    """
    last = history.where((F.col("task_id") == task_id) & (F.col("status") == STATUS["FINISHED"])
                         & (F.col("cyc_time") < cyc_time)).agg(
        F.max_by("end_location", F.struct("cyc_time", "id")).alias("at")).first()["at"]
    return None if last in (None, "", "0") else last


def with_end_locations(history: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs (task_id, id, status, cyc_time, job_id, exec_start_time, exec_end_time) with the ``end_location`` that their metric reports."""
    ends = last_location(metrics, history.where(F.col("status") == STATUS["FINISHED"])).select(
        "id", F.col("location").cast("string").alias("end_location"))
    return history.join(ends, "id", "left")


def start_locations(history: DataFrame, cyc_time: str) -> DataFrame:
    """(task_id, start_location): where the next increment of each task begins, for all tasks at once; null means everything."""
    done = history.where((F.col("status") == STATUS["FINISHED"]) & (F.col("cyc_time") < cyc_time)).groupBy("task_id").agg(
        F.max_by("end_location", F.struct("cyc_time", "id")).alias("at"))
    tasks = history.select("task_id").distinct()
    return tasks.join(done, "task_id", "left").select("task_id", F.when(~F.col("at").isin("", "0"), F.col("at")).alias("start_location"))


def sync_incremental(spark: SparkSession, document: str | Mapping, history: DataFrame, task_id: object,
                     cyc_time: str, **options) -> dict[str, object]:
    """A normal run that starts after the end of the last finished one; without such an end everything is read.

    An increment is added to the target. A job that asks to overwrite it with a part of the source is refused.
    """
    job = SyncJob.parse(document)
    if job.reader.get("increColumn"):
        start = start_location(history, task_id, cyc_time)
        job.reader["startLocation"] = start
        if start is not None and options.get("mode") != "backfill":
            if str(job.writer.setdefault("writeMode", "append")).lower() == "overwrite":
                raise ValueError("an increment would overwrite the rows of earlier runs; use writeMode append")
    return sync(spark, job, **options)


_LEDGER = "numRead long, numWrite long, nErrors long, conversionErrors long, nullErrors long, otherErrors long, batch long"


def stream_report(spark: SparkSession, checkpoint: str, before: int | None = None) -> DataFrame:
    """One row: the counters of a restorable sync over all its batches, or those before one."""
    ledger = spark.read.schema(_LEDGER).parquet(f"{checkpoint}/ledger")
    if before is not None:
        ledger = ledger.where(F.col("batch") < before)
    return ledger.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ledger.columns if c != "batch"])


def _commit(job: SyncJob, checkpoint: str, required: Sequence[str], task_name: str):
    """``foreachBatch`` function that copies a batch: staged once, entered in the ledger, checked, then published.

    Every folder carries the batch number and is replaced as a whole, so a batch that was cut off at any point and comes again
    leaves what one run of it leaves. Limits count all batches: the batch that passes them is not published and fails again until they
    are raised.
    """
    record, percentage = job.limits
    dirty_path = job.setting.get("dirty", {}).get("path")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        targets = _targets(job, batch)
        names = [n for _, n, _ in targets]
        flagged = flag_dirty(batch, targets)
        bad = F.size("_faults") > 0
        for c in required:
            bad = bad | F.col(c).isNull()
        seen = Observation()
        staging = f"{checkpoint}/staging/batch={batch_id}"
        flagged.observe(seen, *counters(required)).withColumn("_bad", bad).write.mode("overwrite").partitionBy("_bad").parquet(staging)
        entry = spark.createDataFrame([{k: int(v) for k, v in seen.get.items()}], _LEDGER.rpartition(",")[0])
        entry.write.mode("overwrite").parquet(f"{checkpoint}/ledger/batch={batch_id}")
        total = stream_report(spark, checkpoint, batch_id + 1).first().asDict()
        check_limits(total, record, percentage)
        staged = spark.read.schema(flagged.withColumn("_bad", F.lit(True)).schema).parquet(staging)
        if dirty_path:
            staged.where("_bad").select(F.col("_row").alias("row"), F.col("_faults").alias("faults")).write.mode("overwrite").parquet(
                f"{dirty_path}/task_name={task_name}/batch={batch_id}")
        kind = job.writer.get("fileType", "parquet")
        staged.where("NOT _bad").select(*names).write.mode("overwrite").format(kind).save(f"{job.writer['path']}/batch={batch_id}")
        drop(spark, staging)
    return write


def sync_stream(spark: SparkSession, document: str | Mapping, checkpoint: str, schema: str,
                options: Mapping[str, str] | None = None, required: Sequence[str] = (), task_name: str = "sync"):
    """A restorable sync: files to files with a checkpoint, everything available now, then stops.

    A run that was interrupted goes on where it stopped, and every row is copied once. Rows at fault are counted by kind, kept
    in the folder for dirty rows if the job names one, and held against its limits, over all runs with this checkpoint. Good rows lie
    in one folder per batch.
    """
    job = SyncJob.parse(document)
    p = job.reader
    stream = spark.readStream.schema(schema).options(**(options or {})).format(
        p.get("fileType", "parquet")).load(p["path"])
    columns = [c["name"] for c in p.get("column", [])]
    rows = stream.select(*columns) if columns else stream
    return rows.writeStream.foreachBatch(_commit(job, checkpoint, required, task_name)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()

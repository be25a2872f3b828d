"""Feeds of status reports, checkpoints, alarms and queue rows.

Most operators are plain DataFrame functions that serve a batch table and a
stream alike. Where order matters per key, the hot-key safe helpers do the work,
for a stream inside ``foreachBatch`` with a small state table beside it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from opsframe import dims
from opsframe.functions.params import render
from opsframe.plans.ordered import carried, find_hot, neighbour, numbered
from opsframe.plans.storage import drop

STREAM, BATCH = 0, 1
NOT_FOUND, FAILED = dims.STATUS["NOTFOUND"], dims.STATUS["FAILED"]


def stamped(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The event time as TIMESTAMP, which watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# --- J1 ------------------------------------------------------------------------------------------

def current_status(reports: DataFrame) -> DataFrame:
    """(job_id, status) after all reports (job_id, status, compute_type, ts, event_id).

    Batch jobs take every report. Stream jobs stay CANCELLING until a stop status
    comes. That rule needs no ordered fold: a stream job is CANCELLING exactly if
    its last CANCELLING report is newer than its last stop report, and else has
    the last report. Three aggregates, combined before the shuffle, also as a
    streaming aggregation in update mode.
    """
    place = F.struct("ts", "event_id")
    s = F.col("status")
    state = reports.groupBy("job_id").agg(
        F.max_by("status", place).alias("_last"), F.max_by("compute_type", place).alias("_kind"),
        F.max(F.when(s == dims.STATUS["CANCELLING"], place)).alias("_cancelling"),
        F.max(F.when(s.isin(dims.STOP), place)).alias("_stop"))
    held = F.col("_cancelling").isNotNull() & (F.col("_stop").isNull() | (F.col("_cancelling") > F.col("_stop")))
    status = F.when((F.col("_kind") == STREAM) & held, dims.STATUS["CANCELLING"]).otherwise(F.col("_last"))
    return state.select("job_id", status.cast("int").alias("status"))


# --- J2 ------------------------------------------------------------------------------------------

def _runs(reports: DataFrame, limit: int | None = None) -> DataFrame:
    """Reports with their place in the job and the place and time at which their NOTFOUND run began."""
    keys, order = ["job_id"], ["ts", "event_id"]
    hot = find_hot(reports, keys, limit)
    rows = numbered(reports, keys, order, "_rn", hot=hot)
    rows = neighbour(rows, keys, order, ["status"], "_prev", hot=hot)
    begins = (F.col("status") == NOT_FOUND) & (F.col("_prev").isNull() | (F.col("_prev.status") != NOT_FOUND))
    return carried(rows, keys, order, F.when(begins, F.struct("_rn", "ts")), "_start", hot=hot)


def debounce_not_found(reports: DataFrame, n: int = 300, span_s: float = 180, limit: int | None = None) -> DataFrame:
    """Reports with NOTFOUND turned to FAILED once it was reported n times or for a span without a break."""
    rows = _runs(reports, limit)
    seconds = (F.unix_micros(F.col("ts").cast("timestamp"))
               - F.unix_micros(F.col("_start.ts").cast("timestamp"))) / 1_000_000
    many = (F.col("_rn") - F.col("_start._rn") + 1 >= n) | (seconds >= span_s)
    lost = F.col("status") == NOT_FOUND
    return rows.withColumn("status", F.when(lost & many, FAILED).otherwise(F.col("status")).cast("int")).select(
        *reports.columns)


_OPEN = "job_id long, count long, start timestamp, batch long"


def debounce_sink(path: str, n: int = 300, span_s: float = 180, limit: int | None = None):
    """``foreachBatch`` function: the same over a stream, stored under ``path/rows``.

    Between micro-batches only the open runs are kept, one row per job that is
    NOTFOUND right now. Inside a batch the hot-key safe batch form works, so a job
    with a third of the reports is split, and no Python touches the rows. Folders
    carry the batch number: a repeated batch reads and writes the same ones.
    Reports must not be older than those of earlier batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _read_open(spark, path, batch_id)
        rows = _runs(batch, limit)
        lost = F.col("status") == NOT_FOUND
        joined = rows.join(before, "job_id", "left")
        # a run that began with the job's first report of the batch goes on from the stored one
        goes_on = (F.col("_start._rn") == 1) & F.col("count").isNotNull()
        count = F.col("_rn") - F.col("_start._rn") + 1 + F.when(goes_on, F.col("count")).otherwise(0)
        start = F.when(goes_on, F.col("start")).otherwise(F.col("_start.ts").cast("timestamp"))
        full = joined.withColumn("_count", F.when(lost, count)).withColumn("_from", F.when(lost, start))
        seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros("_from")) / 1_000_000
        many = (F.col("_count") >= n) | (seconds >= span_s)
        out = full.select("job_id", "event_id", "ts", F.when(lost & many, FAILED).otherwise(F.col("status")).cast(
            "int").alias("status"))
        out.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        last = full.groupBy("job_id").agg(F.max_by(F.struct(
            F.col("_count").alias("count"), F.col("_from").alias("start")), F.col("_rn")).alias("_l"))
        quiet = before.join(last.select("job_id"), "job_id", "left_anti")
        open_ = last.select("job_id", F.col("_l.count").cast("long").alias("count"),
                            F.col("_l.start").alias("start")).where(F.col("count").isNotNull()).unionByName(quiet)
        open_.write.mode("overwrite").parquet(f"{path}/open/batch={batch_id}")
    return write


def _read_open(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """Open runs after the batch before ``batch_id``; none before the first."""
    if batch_id == 0:
        return spark.createDataFrame([], "job_id long, count long, start timestamp")
    return spark.read.schema(_OPEN).parquet(f"{path}/open").where(F.col("batch") == batch_id - 1).drop("batch")


# --- J3, J4 --------------------------------------------------------------------------------------

_HISTORY = ("history ARRAY<STRUCT<id: LONG, trigger_timestamp: LONG, external_path: STRING, status: STRING>>, "
            "counts STRING")
#: Fixed value: what a checkpoint without an address reports as its path.
NO_PATH = "<checkpoint-not-externally-addressable>"


def checkpoint_rows(feed: DataFrame, doc: str = "doc", delay: str = "1 day") -> DataFrame:
    """Completed checkpoints with an external path, once per (run, checkpoint), from JSON histories."""
    parsed = feed.select("task_id", "task_engine_id", F.from_json(doc, _HISTORY).alias("d"))
    rows = parsed.select("task_id", "task_engine_id", F.col("d.counts").alias("checkpoint_counts"),
                         F.explode("d.history").alias("c")).select(
        "task_id", "task_engine_id", F.col("c.id").alias("checkpoint_id"),
        F.timestamp_millis("c.trigger_timestamp").alias("checkpoint_trigger"),
        F.col("c.external_path").alias("checkpoint_savepath"), F.upper("c.status").alias("_status"),
        "checkpoint_counts")
    done = rows.where((F.col("_status") == "COMPLETED") & F.col("checkpoint_savepath").isNotNull()
                      & (F.lower("checkpoint_savepath") != NO_PATH)).drop("_status")
    if feed.isStreaming:
        return done.withWatermark("checkpoint_trigger", delay).dropDuplicatesWithinWatermark(
            ["task_engine_id", "checkpoint_id"])
    return done.dropDuplicates(["task_engine_id", "checkpoint_id"])


#: State of a retention sink is cut into this many folders by run; a batch reads and rewrites those of its runs.
BUCKETS = 64
_KEPT = "task_id long, task_engine_id string, checkpoint_id long, checkpoint_savepath string, is_deleted int"


def _generations(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Batches that wrote each bucket of the state, ascending. At most two are kept of a bucket."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    found = fs.Path(f"{path}/kept/batch=*/bucket=*")
    out: dict[int, list[int]] = {}
    for status in found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []:
        at = status.getPath()
        out.setdefault(int(at.getName().split("=")[1]), []).append(int(at.getParent().getName().split("=")[1]))
    return {b: sorted(n) for b, n in out.items()}


def _read_kept(spark: SparkSession, path: str, batches: Mapping[int, int]) -> DataFrame:
    """The state of some buckets, each as of one batch."""
    folders = [f"{path}/kept/batch={n}/bucket={b}" for b, n in batches.items()]
    return spark.read.schema(_KEPT).parquet(*folders) if folders else spark.createDataFrame([], _KEPT)


def retention_sink(path: str, n: int):
    """``foreachBatch`` function: keeps the n newest checkpoints of each run and notes those that fall below.

    The state holds the n newest of each run and nothing else, in ``BUCKETS`` folders by run. A batch reads the folders of its own runs, as they
    were before it, and writes their next generation; what it reads doesn't grow with the history. All writes replace the batch's own
    folders, and the generation before stays until the next one, so a repeated batch changes nothing. All reported rows
    are appended under ``rows``, the notes under ``gone``; neither is read again. What the batch knows is brought down to one row per
    checkpoint once, in a written step that both the choice and the notes read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("task_engine_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        rows = batch.select("task_id", "task_engine_id", "checkpoint_id", "checkpoint_savepath", F.lit(0).alias("is_deleted"))
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
        stored = spark.read.schema(_KEPT).parquet(f"{path}/rows/batch={batch_id}")
        touched = [r["bucket"] for r in stored.select(bucket).distinct().collect()]  # BUCKETS numbers at most
        made = _generations(spark, path)
        before = {b: max(g) for b in touched if (g := [k for k in made.get(b, []) if k < batch_id])}
        step = f"{path}/known/batch={batch_id}"
        stored.unionByName(_read_kept(spark, path, before)).dropDuplicates(["task_engine_id", "checkpoint_id"]).write.mode(
            "overwrite").parquet(step)
        known = spark.read.schema(_KEPT).parquet(step)
        newest = Window.partitionBy("task_engine_id").orderBy(F.desc("checkpoint_id"))
        ranked = known.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)
        ranked.drop("_rn").select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/kept/batch={batch_id}")
        kept = _read_kept(spark, path, dict.fromkeys(touched, batch_id)).select("task_engine_id", "checkpoint_id")
        gone = known.select("task_engine_id", "checkpoint_id").join(kept, ["task_engine_id", "checkpoint_id"], "left_anti")
        gone.write.mode("overwrite").parquet(f"{path}/gone/batch={batch_id}")
        drop(spark, step)
        for b, g in before.items():  # generations that no repetition of this batch needs
            for old in (k for k in made[b] if k < g):
                drop(spark, f"{path}/kept/batch={old}/bucket={b}")
    return write


def read_retained(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoints that a retention sink still keeps."""
    return _read_kept(spark, path, {b: g[-1] for b, g in _generations(spark, path).items()})


def clean_stopped(checkpoints: DataFrame, stopped: DataFrame) -> DataFrame:
    """Flags all checkpoints of stopped runs that asked for it (``stopped`` has task_engine_id, clean)."""
    runs = stopped.where("clean").select("task_engine_id", F.lit(1).alias("_gone")).distinct()
    return checkpoints.join(runs, "task_engine_id", "left").withColumn(
        "is_deleted", F.coalesce("_gone", "is_deleted").cast("int")).drop("_gone")


# --- J5 ------------------------------------------------------------------------------------------

def silent_jobs(reports: DataFrame, timeout_s: int, now: dt.datetime, limit: int | None = None) -> DataFrame:
    """(job_id, since, status FAILED) for each time an unfinished job sent nothing for ``timeout_s``, up to ``now``."""
    rows = neighbour(reports, ["job_id"], ["ts", "event_id"], ["ts"], "_next", following=True, limit=limit)
    following = F.coalesce(F.col("_next.ts").cast("timestamp"), F.lit(now).cast("timestamp_ntz").cast("timestamp"))
    gap = F.unix_micros(following) - F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.where((gap >= timeout_s * 1_000_000) & ~F.col("status").isin(dims.STOPPED)).select(
        "job_id", F.col("ts").alias("since"), F.lit(FAILED).alias("status"))


_WAITING = "ts long, event_id long, status int"
_LAST = "ts long, event_id long, status int, told boolean"


class _Silence(StatefulProcessor):
    """Per job: its last settled report and the reports that may still be overtaken by older ones.

    A report is settled once the watermark has passed it, so results don't depend on the order of arrival. A timer at the moment when
    the last report turns stale makes silence known without a new report of the job.
    """

    def __init__(self, timeout_us: int, stopped: tuple[int, ...]):
        self.timeout, self.stopped = timeout_us, frozenset(stopped)

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _LAST)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues):
        new = [(r["ts"], r["event_id"], r["status"]) for r in rows]
        return self._settle(key[0], timerValues.getCurrentWatermarkInMs() * 1000, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._settle(key[0], timerValues.getCurrentWatermarkInMs() * 1000, [])

    def _settle(self, job, mark: int, new: list):
        out = []
        last = tuple(self.last.get()) if self.last.exists() else None
        waiting = sorted([*(tuple(r) for r in self.waiting.get()), *new], key=lambda r: (r[0], r[1]))

        def stale(until: int) -> bool:
            return last is not None and not last[3] and last[2] not in self.stopped and until - last[0] >= self.timeout

        ready = [r for r in waiting if r[0] <= mark]
        for report in ready:
            if stale(report[0]):
                out.append(Row(job_id=job, since=last[0]))
            last = (*report, False)
        if stale(mark):
            out.append(Row(job_id=job, since=last[0]))
            last = (*last[:3], True)
        rest = waiting[len(ready):]
        if last is not None:
            self.last.update(last)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [r[0] for r in rest[:1]]
        if last is not None and not last[3] and last[2] not in self.stopped:
            due.append(last[0] + self.timeout)
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))
        return iter(out)

    def close(self) -> None:
        pass


def silent_jobs_stream(reports: DataFrame, timeout_s: int, delay: str = "1 minute") -> DataFrame:
    """The same on a stream, told as soon as the watermark, ``delay`` behind the newest report of any job, shows the silence.

    Keyed state with event-time timers: one settled report per job and what arrived within the delay. Reports behind the watermark are left out
    and counted (``run_to_files``). Needs a state store with timers, see ``run_to_files``.
    """
    marked = stamped(reports).withWatermark("ts", delay).select(
        "job_id", F.col("ts").alias("_at"), F.unix_micros("ts").alias("ts"), "event_id", "status")
    kind = dict(marked.dtypes)["job_id"]
    found = marked.groupBy("job_id").transformWithState(
        _Silence(timeout_s * 1_000_000, tuple(dims.STOPPED)), f"job_id {kind}, since long", "Append", "EventTime")
    return found.select("job_id", F.timestamp_micros("since").alias("since"), F.lit(FAILED).alias("status"))


# --- J6 ------------------------------------------------------------------------------------------

GROUP_CHAT, CUSTOM_GATE = 3, 4
#: Alarms that are sent together, alarms of one task, receivers that travel together. A page of a Parquet file has 20,000 records and must hold
#: a list many times to take little room. The dictionary of a file holds the texts of some 20,000 alarms; after that, each record has its text.
TOGETHER, PER_TASK, LIST = 256, 8192, 128
#: More partitions than any table has: all stay.
_ALL = 1 << 20
#: So many receivers are sent to all executors, 8 bytes each.
FEW = 1_000_000


def _cut(rows: str, n: int) -> Column:
    """A list that is not empty as lists of ``n`` at most."""
    return F.transform(F.sequence(F.lit(0), F.size(rows) - 1, F.lit(n)), lambda k: F.slice(F.col(rows), k + 1, n))


def _lists(receivers: DataFrame, size: int) -> DataFrame:
    """Receivers as lists (_group, users) of ``LIST`` at most. Many are gathered in parts, so that no row takes a whole large group."""
    people = receivers.where(F.col("channel_group").isNotNull()).select(
        F.col("channel_group").alias("_group"), F.col("user_id").cast("long").alias("user_id"))
    rows = people.groupBy("_group", F.pmod(F.xxhash64("user_id"), F.lit(size // (64 * LIST) + 1)).alias("_part")).agg(
        F.collect_list(F.struct("user_id")).alias("_all"))  # in a struct, as null would be left out
    users = F.transform("_all", lambda r: r["user_id"])
    return rows.withColumn("_users", users).select("_group", F.explode(_cut("_users", LIST)).alias("users"))


def build_alerts(alarms: DataFrame, channels: DataFrame, receivers: DataFrame, template: str,
                 values: Mapping[str, Column], keep: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """Alert records of alarms: each channel of the alarm's group times the receivers of the group.

    A group chat gets one record for user -1, and so does a custom channel
    without receivers; other channels without receivers get none. ``alarms`` may
    be a stream, the two dimensions are static. A few alarms make many records, so
    the alarms are spread over all cores first. ``keep`` names columns of the
    alarms that their records carry along.

    ``size`` tells how many alarms a table has. Then some alarms of a group are sent
    together to one list of receivers after the other: records that follow each other
    repeat the same alarm or the same list, which takes files a tenth as large.
    """
    cores = alarms.sparkSession.sparkContext.defaultParallelism
    filled = render(F.lit(template), F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]))
    people = receivers.count()
    texts, lists = alarms.withColumn("content", filled), _lists(receivers, people)
    fields = ["alarm_id", "job_id", "content", *keep]
    if size is None:
        sets, held = texts.select("channel_group", *fields).repartition(4 * cores), fields
    else:
        part = F.pmod(F.xxhash64("alarm_id", "job_id", "content"), F.lit(size // TOGETHER + 1))
        sets = texts.groupBy("channel_group", part.alias("_part")).agg(F.collect_list(F.struct(*fields)).alias("_all"))
        sets = sets.select("channel_group", F.explode(_cut("_all", TOGETHER)).alias("_alarms"))
        sets, held = sets.repartition(max(4 * cores, size // PER_TASK + 1)), ["_alarms"]
    if people <= FEW:
        lists = F.broadcast(lists)
    sent = sets.join(channels, "channel_group", "inner")
    # a chat takes no receivers; its join key is null, so it meets none
    keyed = sent.withColumn("_group", F.when(F.col("gate_type") != GROUP_CHAT, F.col("channel_group")))
    each = keyed.join(lists, "_group", "left").select(
        *held, "channel_id", "gate_type", F.coalesce("users", F.array(F.lit(None).cast("long"))).alias("users"))
    if size is not None:
        # a compiled stage keeps all that it makes of one row; this ends the stage, so that the records of a whole set are never kept
        each = each.coalesce(_ALL).select("channel_id", "gate_type", "users", F.explode("_alarms").alias("_a")).select(
            "channel_id", "gate_type", "users", "_a.*")
    records = each.select(*fields, "channel_id", "gate_type", F.explode("users").alias("user_id"))
    user = F.coalesce("user_id", F.when(F.col("gate_type").isin(GROUP_CHAT, CUSTOM_GATE), F.lit(-1)))
    return records.withColumn("user_id", user.cast("long")).where(F.col("user_id").isNotNull()).select(
        "alarm_id", "channel_id", "gate_type", "user_id", "job_id", "content", F.lit(0).alias("read_status"),
        F.lit(0).alias("alert_record_status"), F.lit(0).alias("alert_record_send_status"), F.lit(0).alias("is_deleted"), *keep)


def record_sink(path: str, build: Callable[[DataFrame], DataFrame]):
    """``foreachBatch`` function that stores the records that ``build`` makes of a micro-batch's alarms in its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch_id}")
    return write


def alert_sink(path: str):
    """``foreachBatch`` function that stores the records of a micro-batch in its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


# --- J8, J9 --------------------------------------------------------------------------------------

def overdue(queue: DataFrame, now: dt.datetime, default_s: int, own: str | None = None) -> DataFrame:
    """Jobs that wait longer than their own limit, or the default one, become AUTOCANCELED."""
    waited = F.unix_seconds(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_seconds(
        F.col("gmt_create").cast("timestamp"))
    limit = F.coalesce(F.col(own), F.lit(default_s)) if own else F.lit(default_s)
    return queue.where(waited > limit).withColumn("status", F.lit(dims.STATUS["AUTOCANCELED"]))


def live_profile(events: DataFrame, size: str, slide: str | None = None, gap: str | None = None,
                 delay: str = "10 minutes", by: tuple[str, ...] = (), ts: str = "ts",
                 limit: int | None = None) -> DataFrame:
    """Counts per tumbling, sliding (``slide``) or session (``gap``) window; late rows are dropped on a stream."""
    rows = stamped(events, ts)
    if rows.isStreaming:
        rows = rows.withWatermark(ts, delay)
    elif gap:
        return _sessions(rows, gap, by, ts, limit)
    window = F.session_window(ts, gap) if gap else F.window(ts, size, slide)
    return rows.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("cnt")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "cnt")


def _sessions(rows: DataFrame, gap: str, by: tuple[str, ...], ts: str, limit: int | None) -> DataFrame:
    """Sessions of a table. The built-in session window sends a key to one task; this splits hot keys."""
    one = rows.select(F.col(ts).alias("_at"), *by, F.lit(0).alias("_one"))
    keys = [*by, "_one"]
    pace = F.expr(f"INTERVAL {gap}")
    hot = find_hot(one, keys, limit)
    marked = neighbour(one, keys, ["_at"], ["_at"], "_prev", hot=hot)
    begins = F.col("_prev").isNull() | (F.col("_at") >= F.col("_prev._at") + pace)
    placed = carried(marked, keys, ["_at"], F.when(begins, F.col("_at")), "start", hot=hot)
    return placed.groupBy("start", *by).agg(
        F.count(F.lit(1)).alias("cnt"), F.max("_at").alias("_last")).select(
        "start", (F.col("_last") + pace).alias("end"), *by, "cnt")


#: The built-in state store that can hold timers and several states per key.
_TIMER_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE_CONF = "spark.sql.streaming.stateStore.providerClass"


def run_to_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", sink: Any = None, timers: bool = False) -> int:
    """Runs a stream over all data available now into Parquet, one folder per micro-batch; returns how many rows came too late.

    ``timers`` picks the state store that keyed state with timers needs, for this stream only.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(
        sink or alert_sink(path)).trigger(availableNow=True)
    conf = stream.sparkSession.conf
    before = conf.get(_STORE_CONF)
    if timers:
        conf.set(_STORE_CONF, _TIMER_STORE)
    try:
        query = writer.start()  # takes its own copy of the settings
    finally:
        conf.set(_STORE_CONF, before)
    query.awaitTermination()
    return sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for o in p["stateOperators"])


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest version of each key that a stream in update mode has stored batch by batch."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in rest])

"""Governance reports: resource limits, audit and alert pages, source registry."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe import dims
from opsframe.functions.text import mem_mb, properties, source_key
from opsframe.operators.filters import audit_search, filter_by, page
from opsframe.operators.tables import upsert

# Limited properties and the names used in messages, per kind of task.
SPARK_KEYS = {"driver.cores": "driverCores", "driver.memory": "driverMemory",
              "executor.instances": "executorInstances", "executor.cores": "executorCores",
              "executor.memory": "executorMemory"}
SYNC_KEYS = {"jobmanager.memory.mb": "jobManagerMemory", "taskmanager.memory.mb": "taskManagerMemory"}
SCRIPT_KEYS = {"worker.memory": "workerMemory", "worker.cores": "workerCores", "worker.num": "workerNum"}
# Task type codes of these kinds.
KEYS_OF_TYPE = {0: SPARK_KEYS, 1: SPARK_KEYS, 3: SPARK_KEYS, 2: SYNC_KEYS, 6: SCRIPT_KEYS, 7: SCRIPT_KEYS}


def over_limit(tasks: DataFrame, limits: DataFrame, on: Sequence[str] = ("project_id",),
               keys: Mapping[str, str] | None = SPARK_KEYS, word: str = "限制") -> DataFrame:
    """Tasks with a property above its limit and the list of messages ``name: value (limit: n)``.

    ``limits`` is unique by ``on`` and has ``resource_limit`` (JSON by property).
    Without a limit row, a limit for the property or the property itself, a task passes. Without ``keys`` the kind of each task, by
    its ``task_type``, decides which properties count; types of no kind pass.
    """
    kinds: dict[tuple[str, str], list[int] | None] = {}
    if keys is not None:
        kinds = {item: None for item in keys.items()}
    else:
        for code, names in KEYS_OF_TYPE.items():
            for item in names.items():
                kinds.setdefault(item, []).append(code)
    # a few kilobytes of tasks hold many texts, so they are spread over all cores; limits are read once per limit row
    spread = tasks.repartition(2 * tasks.sparkSession.sparkContext.defaultParallelism)
    have = spread.withColumn("_p", properties(F.col("task_params")))
    read = {key: F.get_json_object("resource_limit", f"$['{key}']").try_cast("int") for key, _ in kinds}
    bounds = limits.select(*on, F.struct(*[c.alias(f"l{i}") for i, c in enumerate(read.values())]).alias("_limits"))
    joined = have.join(bounds, list(on), "inner")
    messages = []
    for (key, name), types in kinds.items():
        value = F.try_element_at("_p", F.lit(key))
        limit = F.col("_limits")[f"l{list(read).index(key)}"]
        text = F.concat(F.lit(f"{name}: "), value, F.lit(f" ({word}: "), limit.cast("string"), F.lit(")"))
        above = mem_mb(value) > limit
        messages.append(F.when(above if types is None else above & F.col("task_type").isin(types), text))
    found = F.filter(F.array(*messages), lambda m: m.isNotNull())
    # exploding a one-element array keeps the filter from copying the messages into itself
    return joined.select("task_id", F.explode(F.array(found)).alias("messages")).where(F.size("messages") > 0)


def audit_page(log: DataFrame, actions: Mapping[str, str], number: int | None = 1, size: int | None = 20,
               **criteria) -> DataFrame:
    """Audit rows with decoded action text, newest first."""
    rows = audit_search(log, **criteria)
    names = dims.local_table(log.sparkSession, list(actions.items()), "operation string, operation_text string")
    shown = page(rows, "gmt_create", number, size)
    # the action list is a fixed dimension
    return shown.join(F.broadcast(names), "operation", "left").withColumn(
        "operation_text", F.coalesce("operation_text", "operation"))


def alert_page(records: DataFrame, number: int | None = 1, size: int | None = 20, **criteria) -> DataFrame:
    """Alert records by optional criteria, newest id first."""
    return page(filter_by(records, is_deleted=0, **criteria), "id", number, size)


def unread(records: DataFrame, user_id: int | None = None) -> DataFrame:
    return filter_by(records, is_deleted=0, read_status=0, user_id=user_id).orderBy(F.desc("id"))


def pending_alerts(records: DataFrame, start: dt.datetime, end: dt.datetime, status: Sequence[int] = (0,),
                   last: int | None = None, size: int = 500) -> tuple[DataFrame, DataFrame]:
    """(count, next ``size`` rows by id) of alerts in a time range and state."""
    rows = filter_by(records, is_deleted=0, alert_record_status=list(status)).where(
        F.col("gmt_created").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    batch = rows if last is None else rows.where(F.col("id") > last)
    return rows.agg(F.count(F.lit(1)).alias("cnt")), batch.orderBy("id").limit(size)


def registered_key(url: Column, source_type: Column, name: Column) -> Column:
    """Key of a source: ``custom_<name>`` for custom and unknown types, else from its address."""
    own = source_type.isin(dims.SOURCE_TYPE["CUSTOM"], dims.SOURCE_TYPE["UNKNOWN"])
    return F.when(own, F.concat(F.lit("custom_"), name)).otherwise(source_key(url, source_type))


def register_sources(base: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, rejected). Known ids are updated if their key is unchanged, else rejected; new ids are added.

    Both have (id, source_name, source_type, url); base also has source_key.
    """
    keyed = new.withColumn("source_key", registered_key(F.col("url"), F.col("source_type"), F.col("source_name")))
    old = base.select("id", F.col("source_key").alias("_old"))
    checked = keyed.join(old, "id", "left")
    moved = F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.col("source_key"))
    good = checked.where(~moved).drop("_old")
    return upsert(base, good, ["id"], ["source_name", "source_type", "url"]), checked.where(moved).drop("_old")

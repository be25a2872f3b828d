"""Instance keys ``prefix_taskShadeId_yyyyMMddHHmmss`` and instance names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKFILL_PREFIX = "fillData"


def decode_job_key(key: Column) -> Column:
    """Struct (task_shade_id, cyc_time, day, type); a key with fewer than two parts gives id -1."""
    parts = F.split(key, "_")
    cyc = F.element_at(parts, -1)
    short = F.size(parts) < 2
    return F.struct(
        F.when(short, F.lit(-1)).otherwise(F.try_element_at(parts, F.lit(-2)).try_cast("long"))
        .cast("long").alias("task_shade_id"),
        cyc.alias("cyc_time"),
        F.substring(cyc, 1, 8).alias("day"),
        F.when(key.startswith(BACKFILL_PREFIX), 1).otherwise(0).alias("type"),
    )


def key_day(key: Column) -> Column:
    return F.substring(F.element_at(F.split(key, "_"), -1), 1, 8)


def key_task(key: Column) -> Column:
    return F.try_element_at(F.split(key, "_"), F.lit(-2)).try_cast("long")


def job_key(prefix: Column, task_shade_id: Column, time: Column) -> Column:
    return F.concat_ws("_", prefix, task_shade_id.cast("string"), F.translate(time, "-: ", ""))


def job_name(task_name: Column, time: Column, fill_name: Column | None = None) -> Column:
    """``name_time`` for normal instances, ``fill-task-time`` for backfills."""
    time = F.translate(time, "-: ", "")
    if fill_name is None:
        return F.concat_ws("_", task_name, time)
    return F.concat_ws("-", fill_name, task_name, time)


def task_name(name: Column, schedule_type: Column) -> Column:
    """Task name inside an instance name."""
    dashed = F.split(name, "-")
    backfill = F.when(F.size(dashed) == 3, F.try_element_at(dashed, F.lit(2))).otherwise(name)
    between = F.regexp_extract(name, r"(?s)^[^_]*_(.*)_[^_]*$", 1)
    normal = F.when(name.contains("_"), between).otherwise(name)
    return F.when(schedule_type == 1, backfill).otherwise(normal)

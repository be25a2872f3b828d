"""The expressions and the calendar as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from opsframe.operators.calendar import triggers_sql

_DURATION = """
CASE WHEN ms IS NULL OR ms = 0 THEN '0秒' WHEN ms < 1000 THEN concat(ms, '毫秒')
     ELSE concat(CASE WHEN ms div 3600000 > 0 THEN concat(ms div 3600000, '小时') ELSE '' END,
                 CASE WHEN ms div 60000 % 60 > 0 THEN concat(ms div 60000 % 60, '分钟') ELSE '' END,
                 CASE WHEN ms div 1000 % 60 > 0 THEN concat(ms div 1000 % 60, '秒') ELSE '' END) END
"""

# name -> (parameters, result type, body)
SCALAR_FUNCTIONS = {
    "duration_text": ("ms BIGINT", "STRING", _DURATION),
    "strip_time": ("t STRING", "STRING", "translate(t, '-: ', '')"),
    "split_time": ("t STRING", "STRING",
                   "CASE WHEN length(t) = 14 THEN regexp_replace(t, '^(.{4})(.{2})(.{2})(.{2})(.{2})(.{2})$', "
                   "'$1-$2-$3 $4:$5:$6') ELSE t END"),
    "mem_mb": ("t STRING", "INT",
               "try_cast(regexp_extract(trim(t), '^([0-9]+)[ ]*[gGmM]?$', 1) AS INT) * "
               "CASE WHEN lower(trim(t)) LIKE '%g' THEN 1024 ELSE 1 END"),
    "cyc_shift": ("cyc STRING, years INT, months INT, days INT, hours INT, mins INT", "STRING",
                  "date_format(try_to_timestamp(cyc, 'yyyyMMddHHmmss') + "
                  "make_interval(years, months, 0, days, hours, mins, 0), 'yyyyMMddHHmmss')"),
    "biz_day": ("cyc STRING", "STRING",
                "concat_ws('-', substring(cyc, 1, 4), substring(cyc, 5, 2), substring(cyc, 7, 2))"),
    "key_cyc": ("k STRING", "STRING", "element_at(split(k, '_'), -1)"),
    "key_task": ("k STRING", "BIGINT", "try_cast(try_element_at(split(k, '_'), -2) AS BIGINT)"),
}

def register(spark: SparkSession) -> list[str]:
    """Creates the scalar functions and the table function ``triggers(rule, day)``; returns their names."""
    for name, (args, kind, body) in SCALAR_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body.strip()}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION triggers(conf_text STRING, on_day STRING) "
              f"RETURNS TABLE (trigger_time TIMESTAMP_NTZ) RETURN {triggers_sql('conf_text', 'on_day').strip()}")
    return [*SCALAR_FUNCTIONS, "triggers"]

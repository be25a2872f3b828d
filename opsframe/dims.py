"""Enumerations as plain values and as small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Status codes as stored in the instance table.
STATUS = {
    "UNSUBMIT": 0, "CREATED": 1, "SCHEDULED": 2, "DEPLOYING": 3, "RUNNING": 4, "FINISHED": 5, "CANCELLING": 6,
    "CANCELED": 7, "FAILED": 8, "SUBMITFAILD": 9, "SUBMITTING": 10, "RESTARTING": 11, "MANUALSUCCESS": 12,
    "KILLED": 13, "SUBMITTED": 14, "NOTFOUND": 15, "WAITENGINE": 16, "WAITCOMPUTE": 17, "FROZEN": 18,
    "ENGINEACCEPTED": 19, "ENGINEDISTRIBUTE": 20, "PARENTFAILED": 21, "FAILING": 22, "COMPUTING": 23, "EXPIRE": 24,
    "LACKING": 25, "AUTOCANCELED": 26,
}
STATUS_NAME = {code: name for name, code in STATUS.items()}

# Groups of status codes.
FINISH = [5, 12]
RUNNING = [4, 15]
FAILED = [8, 9, 21, 22]
RUN_FAILED = [8, 22]
WAIT = [1, 2, 3, 11, 14, 16, 17, 19, 20, 23, 25]
STOP = [7, 13, 24, 26]
EXPIRED = [24, 26]
STOPPED = [5, 7, 8, 9, 12, 13, 18, 21, 24, 26]

# The eight merged buckets and the ten failure-split buckets (bucket code -> member codes).
MERGED = {0: [0], 4: RUNNING, 5: FINISH, 8: FAILED, 16: WAIT, 10: [10], 7: STOP, 18: [18]}
SPLIT = {0: [0], 4: RUNNING, 5: FINISH, 8: RUN_FAILED, 9: [9], 21: [21], 16: WAIT, 10: [10], 7: STOP, 18: [18]}

# Outcomes of the readiness check.
READINESS = {
    "CAN_EXE": 0, "TIME_NOT_REACH": 1, "FATHER_JOB_NOT_FINISHED": 2, "FATHER_JOB_EXCEPTION": 3,
    "TIME_OVER_EXPIRE": 4, "TASK_PAUSE": 5, "NO_TASK": 6, "NOT_UNSUBMIT": 7, "SELF_PRE_PERIOD_EXCEPTION": 8,
    "TASK_DELETE": 9, "FATHER_NO_CREATED": 10, "DEPENDENCY_JOB_CANCELED": 11, "DEPENDENCY_JOB_FROZEN": 12,
    "CHILD_PRE_NOT_FINISHED": 13, "DEPENDENCY_JOB_EXPIRE": 14, "CHILD_PRE_NOT_SUCCESS": 15,
    "RESOURCE_OVER_LIMIT": 16,
}

# Small code lists.
DEPENDENCY = {"NONE": 0, "SELF_SUCCESS": 1, "CHILD_PRE_SUCCESS": 2, "SELF_END": 3, "CHILD_PRE_END": 4}
PERIOD = {"MIN": 0, "HOUR": 1, "DAY": 2, "WEEK": 3, "MONTH": 4}
SCHEDULE = {"NORMAL": 0, "FILL": 1, "TEMP": 2, "RESTART": 3}
STAGE = {"DB": 1, "PRIORITY": 2, "RESTART": 3, "LACKING": 4, "SUBMITTED": 5}
FLOW_TYPES = [10, 14]

# Source type codes.
SOURCE_TYPE = {
    "MySQL": 1, "Oracle": 2, "SQLServer": 3, "PostgreSQL": 4, "RDBMS": 5, "HDFS": 6, "HIVE": 7, "HBASE": 8, "FTP": 9,
    "MAXCOMPUTE": 10, "ES": 11, "REDIS": 12, "MONGODB": 13, "KAFKA_11": 14, "ADS": 15, "BEATS": 16, "KAFKA_10": 17,
    "KAFKA_09": 18, "DB2": 19, "CarbonData": 20, "LIBRA": 21, "GBase_8a": 22, "Kylin": 23, "Kudu": 24,
    "Clickhouse": 25, "KAFKA": 26, "HIVE1X": 27, "Polardb_For_MySQL": 28, "IMPALA": 29, "Phoenix": 30, "TiDB": 31,
    "SQLSERVER_2017_LATER": 32, "ES6": 33, "EMQ": 34, "DMDB": 35, "GREENPLUM6": 36, "Presto": 37, "PHOENIX5": 38,
    "KINGBASE8": 40, "VERTICA": 43, "CUSTOM": 1000, "MySQL8": 1001, "Spark": 1002, "UNKNOWN": 3000,
}


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table as an inline SQL relation: known size, no Python worker."""
    names = [part.split()[0] for part in ddl.split(",")]
    casts = [f"cast({n} as {part.split()[1]}) as {n}" for n, part in zip(names, ddl.split(","), strict=True)]

    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {', '.join(casts)} FROM VALUES {body} AS t({', '.join(names)})")


def bucket_table(spark: SparkSession, split: bool = False) -> DataFrame:
    """(bucket, bucket_name, status): one row per status code that belongs to a bucket."""
    groups = SPLIT if split else MERGED
    rows = [(code, STATUS_NAME[code], member) for code, members in groups.items() for member in members]
    return local_table(spark, rows, "bucket int, bucket_name string, status int")


def bucket_names(spark: SparkSession, split: bool = False) -> DataFrame:
    """(bucket, bucket_name): one row per bucket."""
    groups = SPLIT if split else MERGED
    return local_table(spark, [(c, STATUS_NAME[c]) for c in groups], "bucket int, bucket_name string")


def code_table(spark: SparkSession, codes: dict[str, int]) -> DataFrame:
    """(name, code) for any of the enumerations above."""
    return local_table(spark, list(codes.items()), "name string, code int")

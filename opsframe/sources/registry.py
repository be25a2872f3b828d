"""Readers and writers by source type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from opsframe.dims import SOURCE_TYPE

# JDBC driver class per dialect. The jars come with the cluster, not with this package.
DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver", "oracle": "oracle.jdbc.OracleDriver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "postgresql": "org.postgresql.Driver",
    "db2": "com.ibm.db2.jcc.DB2Driver", "tidb": "com.mysql.cj.jdbc.Driver",
    "greenplum": "org.postgresql.Driver", "hive": "org.apache.hive.jdbc.HiveDriver",
    "impala": "com.cloudera.impala.jdbc41.Driver", "presto": "com.facebook.presto.jdbc.PrestoDriver",
    "kingbase": "com.kingbase8.Driver", "kylin": "org.apache.kylin.jdbc.Driver",
}

_DIALECT_OF = {
    "MySQL": "mysql", "MySQL8": "mysql", "Polardb_For_MySQL": "mysql", "Oracle": "oracle", "SQLServer": "sqlserver",
    "SQLSERVER_2017_LATER": "sqlserver", "PostgreSQL": "postgresql", "LIBRA": "postgresql", "DB2": "db2",
    "TiDB": "tidb", "GREENPLUM6": "greenplum", "IMPALA": "impala", "Presto": "presto", "KINGBASE8": "kingbase",
    "Kylin": "kylin",
}
_TABLES = ["HIVE", "HIVE1X", "Spark", "CarbonData"]
_FILES = ["HDFS", "FTP"]
_TOPICS = ["KAFKA", "KAFKA_09", "KAFKA_10", "KAFKA_11"]


class UnsupportedSource(ValueError):
    """No reader or writer for a source type."""


def read_jdbc(spark: SparkSession, dialect: str, url: str, query: str | None = None, table: str | None = None,
              split: tuple[str, object, object, int] | None = None, options: Mapping[str, str] | None = None,
              ) -> DataFrame:
    """A query or table of a database. ``split`` = (column, lower, upper, ranges) reads a table in parallel ranges.

    Written against the public JDBC options; the test environment has no database.
    """
    if dialect not in DRIVERS:
        raise UnsupportedSource(f"unknown dialect {dialect}")
    reader = spark.read.format("jdbc").option("url", url).option("driver", DRIVERS[dialect]).option(
        "fetchsize", "10000").options(**(options or {}))
    if split is None:
        return (reader.option("query", query) if query else reader.option("dbtable", table)).load()
    column, lower, upper, ranges = split
    target = f"({query}) q" if query else table
    return reader.option("dbtable", target).option("partitionColumn", column).option("lowerBound", str(lower)).option(
        "upperBound", str(upper)).option("numPartitions", str(ranges)).load()


def jdbc_bounds(spark: SparkSession, dialect: str, url: str, table: str, column: str, **options) -> tuple:
    """(min, max) of a split column, asked from the database."""
    row = read_jdbc(spark, dialect, url, f"SELECT min({column}) AS lo, max({column}) AS hi FROM {table}",
                    options=options).first()
    return row["lo"], row["hi"]


def read_files(spark: SparkSession, path: str | Sequence[str], kind: str, schema: str | None = None,
               delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """orc, parquet, json, or delimited text; text needs a schema and is read without inferring one."""
    kind = kind.lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind in ("text", "csv"):
        return reader.option("sep", delimiter).option("encoding", encoding).csv(path)
    if kind not in ("orc", "parquet", "json"):
        raise UnsupportedSource(f"unknown file type {kind}")
    return reader.format(kind).load(path)


def read_kafka(spark: SparkSession, servers: str, topic: str, streaming: bool = False) -> DataFrame:
    """A topic's records; needs the Kafka package of the Spark distribution on the class path."""
    reader = spark.readStream if streaming else spark.read
    return reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()


def _read_table(spark: SparkSession, parameter: Mapping) -> DataFrame:
    return spark.table(parameter["table"])


def _read_path(spark: SparkSession, parameter: Mapping) -> DataFrame:
    return read_files(spark, parameter["path"], parameter.get("fileType", "parquet"), parameter.get("schema"),
                      parameter.get("fieldDelimiter", ","), parameter.get("encoding", "UTF-8"))


def _read_database(dialect: str):
    def read(spark: SparkSession, parameter: Mapping) -> DataFrame:
        login = {k: parameter[k2] for k, k2 in (("user", "username"), ("password", "password")) if k2 in parameter}
        channels, pk, table = int(parameter.get("channel", 1)), parameter.get("splitPk"), parameter.get("table")
        if channels > 1 and pk and not parameter.get("customSql"):
            lo, hi = jdbc_bounds(spark, dialect, parameter["jdbcUrl"], table, pk, **login)
            if lo is not None:
                return read_jdbc(spark, dialect, parameter["jdbcUrl"], table=table, split=(pk, lo, hi, channels),
                                 options=login)
        return read_jdbc(spark, dialect, parameter["jdbcUrl"], parameter.get("customSql") or None, table,
                         options=login)
    return read


def _read_topic(spark: SparkSession, parameter: Mapping) -> DataFrame:
    return read_kafka(spark, parameter["servers"], parameter["topic"])


SOURCES = {
    **{SOURCE_TYPE[n]: _read_database(d) for n, d in _DIALECT_OF.items()},
    **{SOURCE_TYPE[n]: _read_table for n in _TABLES}, **{SOURCE_TYPE[n]: _read_path for n in _FILES},
    **{SOURCE_TYPE[n]: _read_topic for n in _TOPICS},
}


def read_source(spark: SparkSession, source_type: int, parameter: Mapping) -> DataFrame:
    """The rows of a source by its type code."""
    if source_type not in SOURCES:
        names = {v: k for k, v in SOURCE_TYPE.items()}
        raise UnsupportedSource(f"no reader for source type {names.get(source_type, source_type)}")
    return SOURCES[source_type](spark, parameter)

"""SQL scripts: splitting, running in order, parameters, ad-hoc queries and column lists."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.functions.params import resolve_params

# A run of plain text, a quoted text (a backslash keeps the next character) or a lone quote.
_TOKEN = re.compile(r"""[^;'"]+|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|;|['"]""", re.S)


def split_statements(text: str) -> list[str]:
    """Statements between semicolons that stand outside quotes; blank ones are dropped."""
    out, part = [], []
    for token in _TOKEN.findall(text):
        if token == ";":
            out.append("".join(part))
            part = []
        else:
            part.append(token)
    out.append("".join(part))
    return [s.strip() for s in out if s.strip()]


@dataclass
class ScriptResult:
    """The last statement's rows and one (position, statement, state) entry per statement."""

    last: DataFrame | None = None
    report: list[tuple[int, str, str]] = field(default_factory=list)

    def report_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.report, "position int, statement string, state string")


class ScriptError(RuntimeError):
    """A statement failed; ``result`` tells how far the script came."""

    def __init__(self, message: str, result: ScriptResult) -> None:
        super().__init__(message)
        self.result = result


@contextmanager
def session_conf(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def _database(spark: SparkSession, name: str | None, location: str | None = None) -> Iterator[None]:
    before = spark.catalog.currentDatabase()
    if name:
        if location:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{location}'")
        spark.catalog.setCurrentDatabase(name)
    try:
        yield
    finally:
        spark.catalog.setCurrentDatabase(before)


def run_script(spark: SparkSession, text: str, conf: Mapping[str, str] | None = None, skip_select: bool = False,
               app_name: str | None = None, database: str | None = None, location: str | None = None) -> ScriptResult:
    """Runs the statements in order and stops at the first error; later ones see the tables of earlier ones.

    ``skip_select`` leaves out statements that start with ``select``;
    ``database`` and ``location`` name the store the script works in.
    """
    result = ScriptResult()
    if app_name:
        spark.sparkContext.setJobDescription(app_name)
    with session_conf(spark, conf or {}), _database(spark, database, location):
        for i, statement in enumerate(split_statements(text)):
            if skip_select and statement.lower().startswith("select"):
                result.report.append((i, statement, "skipped"))
                continue
            try:
                result.last = spark.sql(statement)
            except Exception as e:
                result.report.append((i, statement, "failed"))
                raise ScriptError(f"statement {i} failed: {e}", result) from e
            result.report.append((i, statement, "done"))
    return result


def render_script(spark: SparkSession, text: str, params: DataFrame | Iterable[tuple[int, str, str]], cyc_time: str,
                  now: str) -> str:
    """A script with its ``${name}`` parameters filled in; without ``${`` nothing is looked up."""
    if "${" not in text:
        return text
    if not isinstance(params, DataFrame):
        rows = list(params)
        if not rows:
            return text
        params = spark.createDataFrame(rows, "type int, param_name string, param_command string")
    # as many rows as the script has variables, whatever the table holds
    params = params.where(F.col("param_name").isin(sorted(set(re.findall(r"\$\{([^}]*)\}", text)))))
    resolved = resolve_params(params, F.lit(cyc_time), F.lit(now), on_error="raise")
    for row in resolved.select("param_name", "value").collect():
        text = text.replace("${" + row["param_name"] + "}", row["value"])
    return text


def run_sql_job(spark: SparkSession, text: str, params: DataFrame | Iterable[tuple[int, str, str]], cyc_time: str,
                now: str, **options) -> ScriptResult:
    """A parameterised script at a cycle time."""
    return run_script(spark, render_script(spark, text, params, cyc_time, now), **options)


def query(spark: SparkSession, sql: str, database: str | None = None) -> DataFrame | None:
    """Ad-hoc query in a database; a column called ``t.c`` is reported as ``c``. A blank query gives None."""
    if not sql.strip():
        return None
    with _database(spark, database):
        df = spark.sql(sql)
    return df.toDF(*[c.split(".")[1] if "." in c else c for c in df.columns])


def list_columns(spark: SparkSession, table: str) -> DataFrame:
    """(name, type, comment) of a table or view; as many rows as it has columns."""
    rows = [(c.name, c.dataType, c.description or "") for c in spark.catalog.listColumns(table)]
    return spark.createDataFrame(rows, "name string, type string, comment string")

"""Table and column lineage: closures, views, keys and edges found in SQL texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.operators.graph import ancestors, descendants, pair

INPUT, RESULT = "input_table_id", "result_table_id"


def table_upstream(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """All edges that lead, directly or not, to the given tables (column ``root``); safe with cycles."""
    return ancestors(edges, tables, None, INPUT, RESULT)


def table_downstream(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """All edges that start, directly or not, at the given tables."""
    return descendants(edges, tables, None, INPUT, RESULT)


def table_lineage(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Upstream and downstream edges without duplicates."""
    cols = ["root", INPUT, RESULT]
    return table_upstream(edges, tables).select(*cols).unionByName(
        table_downstream(edges, tables).select(*cols)).distinct()


_IN, _OUT = ("input_table_id", "input_column_name"), ("result_table_id", "result_column_name")


def _column_walk(edges: DataFrame, columns: DataFrame, up: bool) -> DataFrame:
    links = edges.select(pair(*_IN).alias("i"), pair(*_OUT).alias("o"))
    roots = columns.select(pair("table_id", "column_name").alias("root"))
    step = ancestors if up else descendants
    out = step(links, roots, None, "i", "o")
    return out.select(
        F.col("root.k0").alias("root_table_id"), F.col("root.k1").alias("root_column_name"), "level",
        F.col("i.k0").alias(_IN[0]), F.col("i.k1").alias(_IN[1]),
        F.col("o.k0").alias(_OUT[0]), F.col("o.k1").alias(_OUT[1]))


def column_upstream(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Column edges above the given (table_id, column_name) rows."""
    return _column_walk(edges, columns, True)


def column_downstream(edges: DataFrame, columns: DataFrame) -> DataFrame:
    return _column_walk(edges, columns, False)


def lineage_columns(edges: DataFrame, side: str = "input", tables: DataFrame | None = None) -> DataFrame:
    """Columns that feed (``input``) or are fed by (``result``) lineage, for all or for given tables."""
    table, column = _IN if side == "input" else _OUT
    out = edges.select(F.col(table).alias("table_id"), F.col(column).alias("column_name"))
    if tables is not None:
        out = out.join(tables.select("table_id"), "table_id", "left_semi")
    return out.distinct()


def lineage_view(edges: DataFrame, datasets: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges with both data sets resolved, and the source of the input data set."""
    names = datasets.select("id", "db_name", "table_name", "source_id")
    left = names.select(F.col("id").alias(INPUT), F.col("db_name").alias("input_db"),
                        F.col("table_name").alias("input_table"), "source_id")
    right = names.select(F.col("id").alias(RESULT), F.col("db_name").alias("result_db"),
                         F.col("table_name").alias("result_table"))
    src = sources.select(F.col("id").alias("source_id"), "source_name", "source_type")
    return edges.join(left, INPUT, "inner").join(right, RESULT, "inner").join(src, "source_id", "left")


def table_edge_key(a: Column, b: Column) -> Column:
    return F.concat_ws("_", a.cast("string"), b.cast("string"))


def column_edge_key(in_table: Column, in_col: Column, out_table: Column, out_col: Column) -> Column:
    """md5 of ``table.column_table.column``."""
    return F.md5(F.concat_ws("_", F.concat_ws(".", in_table.cast("string"), in_col),
                             F.concat_ws(".", out_table.cast("string"), out_col)))


# String literals and comments: each is one match, so long texts are scanned once.
_NOISE = r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|--[^\n]*|/\*(?s:.*?)\*/"""
_NAME = r"[\w.`$]+"
_STOP = r"(?!(?:join|left|right|inner|full|outer|cross|where|group|order|sort|on|union|having|limit|lateral|semi|anti|natural|using|set|select)\b)"
_TARGET = rf"(?i)\binsert\s+(?:overwrite|into)\s+(?:table\s+)?({_NAME})"
_MERGED = rf"(?i)\bmerge\s+into\s+({_NAME})"
_USED = rf"(?i)\bmerge\s+into\s+{_NAME}(?:\s+(?:as\s+)?(?!using\b)\w+)?\s+using\s+({_NAME})"
# a view that outlives its session is a target like a table
_CREATED = rf"(?is)\bcreate\s+(?:(?:\w+\s+){{0,3}}?table|(?:or\s+replace\s+)?(?:materialized\s+)?view)\s+(?:if\s+not\s+exists\s+)?({_NAME})\b.*?\bas\b\s*\(?\s*(?:select|with)\b"
_SOURCES = rf"(?i)\b(?:from|join)\s+((?:{_NAME}(?:\s+(?:as\s+)?{_STOP}\w+)?\s*,\s*)*{_NAME})"
_CTES = r"(?i)(?:\bwith|\)\s*,)\s*(?:recursive\s+)?([\w`]+)\s*(?:\([^()]*\)\s*)?as\s*\("


def table_edges_from_sql(scripts: DataFrame, text: str = "sql_text", default_db: str = "default") -> DataFrame:
    """(…, input_table, result_table) for INSERT, MERGE and CREATE TABLE or VIEW AS statements in a column of scripts.

    Literals and comments are blanked first, so that a ``;`` or a table name in
    them means nothing. Names get the default database, CTE names are dropped.
    """
    keep = [c for c in scripts.columns if c != text]
    quiet = F.regexp_replace(F.col(text), _NOISE, " ")
    statements = scripts.select(*keep, F.explode(F.split(quiet, ";")).alias("_s")).where(F.trim("_s") != "")
    # several INSERTs of one statement share what it reads; a statement creates or merges one target
    targets = F.concat(*[F.regexp_extract_all("_s", F.lit(p), F.lit(1)) for p in (_TARGET, _MERGED, _CREATED)])
    lists = F.transform(F.regexp_extract_all("_s", F.lit(_SOURCES), F.lit(1)), lambda s: F.split(s, ","))
    words = F.transform(F.flatten(lists), lambda s: F.regexp_extract(F.trim(s), rf"^({_NAME})", 1))

    def clean(c: Column) -> Column:
        return F.lower(F.replace(c, F.lit("`"), F.lit("")))

    def full(c: Column) -> Column:
        return F.when(c.contains("."), c).otherwise(F.concat(F.lit(f"{default_db}."), c))

    ctes = F.transform(F.regexp_extract_all("_s", F.lit(_CTES), F.lit(1)), clean)
    used = F.regexp_extract_all("_s", F.lit(_USED), F.lit(1))
    names = F.array_except(F.transform(F.concat(words, used), clean), ctes)
    found = statements.select(*keep, F.array_distinct(F.transform(targets, clean)).alias("_t"), F.explode(names).alias("_i")).select(
        *keep, F.explode("_t").alias("_t"), "_i")
    return found.where((F.col("_t") != "") & (F.col("_i") != "")).select(
        *keep, full(F.col("_i")).alias("input_table"), full(F.col("_t")).alias("result_table")).distinct()

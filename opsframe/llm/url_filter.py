"""URL filters: a broadcast trie over reversed host labels and path segments."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.common import read

#: (verdict, host, path) as the list of the registered query gives them.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: A trie is broadcast to every executor, so its rules are counted first.
MAX_RULES = 2_000_000

_AFTER = re.compile(r"([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Host labels from the right, then path segments.

    The last segment of a rule's path is only a prefix of the url's segment ("/en/" ends with the
    empty one). Of two rules with the same host and path, ``block`` holds.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.translate(_LOWER).split(".")):
            node = node.setdefault("sub", {}).setdefault(label, {})
        *whole, last = path.split("/")
        node = node.setdefault("paths", {})
        for segment in whole:
            node = node.setdefault("next", {}).setdefault(segment, {})
        ends = node.setdefault("ends", {})
        if ends.get(last, ("", ""))[1] != "block":
            ends[last] = (f"{host}{path}", verdict)
        node["widths"] = sorted({len(x) for x in ends}, reverse=True)
    return root


def _longest_path(node: dict, path: str) -> tuple[str, str] | None:
    found, segments = None, path.split("/")
    for k, segment in enumerate(segments):
        ends = node.get("ends")
        if ends:
            for width in node["widths"]:
                if width <= len(segment) and segment[:width] in ends:
                    found = ends[segment[:width]]
                    break
        node = node.get("next", {}).get(segment) if k < len(segments) - 1 else None
        if node is None:
            break
    return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case and path; both empty without a ``://``."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    host, path = _AFTER.match(url, at + 3).groups()
    return host.translate(_LOWER), path


def look_up(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule with the most host labels, among those the one with the longest path."""
    node, found = trie, None
    for label in reversed(host.split(".")):
        node = node.get("sub", {}).get(label)
        if node is None:
            break
        if "paths" in node:
            found = _longest_path(node["paths"], path) or found
    return found


def judge(spark: SparkSession, url: Column, rules: list[tuple[str, str, str]], otherwise: str = "allow") -> Column:
    """A struct (host, path, rule, verdict) for a url column.

    A null url, or one without ``://``, has an empty host and path. ``rule`` is null where none fits, and
    the verdict is then ``otherwise``. Urls of any length and equal urls need no special care.
    """
    trie = spark.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def run(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for u in urls:
            host, path = split_url(u)
            rule, verdict = look_up(trie.value, host, path) or (None, otherwise)
            rows.append((host, path, rule, verdict))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"], dtype=object)

    return run(url)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by ``RULES``; one row per row of ``pages``."""
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    return pages.select("page_id", judge(spark, F.col("url"), RULES).alias("j")).select(
        "page_id", "j.host", "j.path", "j.rule", "j.verdict"
    )


_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_RULE_ROWS}),
parts AS (
  SELECT row_number() OVER () AS k, page_id,
    translate(CASE WHEN strpos(coalesce(url, ''), '://') > 0
      THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') ELSE '' END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0
      THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
best AS (
  SELECT k, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule,
    arg_max(verdict, length(rhost) * 1000 + length(rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (k)
"""

"""Members of JSON documents by path, beside Python's own."""

import json

import pytest
from pyspark.sql import functions as F

from opsframe.functions.text import json_drop, json_put

DOCS = [
    '{"job":{"reader":{"startLocation":"1","sql":"a,}\\"{"},"writer":{"startLocation":"2"}}}',
    '{"job":{"reader":{},"writer":[{"startLocation":1},{"startLocation":2}]}}',
    '{"job":{"reader":{"startLocation":{"deep":[1,2.5,null,true]},"n":12345678901234567890123}}}',
    '{"job":{"reader":"text"}}', '{"other":1}', "{}", "[1,2]", '"x"', "5",
]


def edited(doc, path, put):
    doc = json.loads(doc)
    at = doc
    for name in path[:-1]:
        if not isinstance(at, dict):
            return doc
        if name not in at:
            if put is None:
                return doc
            at[name] = {}
        at = at[name]
    if isinstance(at, dict):
        if put is None:
            at.pop(path[-1], None)
        else:
            at[path[-1]] = put
    return doc


@pytest.mark.parametrize("path", [["job", "reader", "startLocation"], ["job", "writer", "startLocation"], ["job", "new", "a", "b"], ["top"]])
def test_edits_by_path(spark, path):
    df = spark.createDataFrame([(d,) for d in DOCS], "doc string")
    value = 'say "a,}" \\ é'
    for r in df.select("doc", json_drop(F.col("doc"), *path).alias("dropped"), json_put(F.col("doc"), path, F.lit(value)).alias("put")).collect():
        assert json.loads(r["dropped"]) == edited(r["doc"], path, None)
        assert json.loads(r["put"]) == edited(r["doc"], path, value)


def test_odd_documents(spark):
    df = spark.createDataFrame([(None,), ("no json",)], "doc string")
    assert [tuple(r) for r in df.select(json_drop(F.col("doc"), "a"), json_put(F.col("doc"), ["a"], F.lit("x"))).collect()] == [(None, None)] * 2
    one = spark.createDataFrame([('{"a":1}', None)], "doc string, v string")
    assert one.select(json_put(F.col("doc"), ["a"], F.col("v"))).first()[0] == '{"a":null}'

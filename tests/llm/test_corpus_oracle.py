"""Queries of the corpus operators that SQL can express, beside DuckDB; the others at least give rows of the agreed shape."""

import duckdb
import pytest

from opsframe.llm import registry

FOLDER = "/root/testdata/sf0.001"
SHAPES = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op5_page_text": ["page_id", "url", "text", "n_chars"],
    "op7_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8_simhash": ["doc_id", "fingerprint", "component_id"],
    "op12_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op10_decontaminate": ["doc_id", "item_id", "similarity", "first_word"],
}


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_query_beside_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    df = registry.QUERIES[name](spark, FOLDER)
    columns = ", ".join(df.columns)
    want = con.execute(f"SELECT {columns} FROM ({registry.ORACLE[name]}) AS o").fetchall()
    got = [tuple(r) for r in df.collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", list(SHAPES))
def test_query_has_its_columns(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).columns == SHAPES[name]


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(registry.QUERIES) == set(registry.ORACLE) | set(SHAPES)

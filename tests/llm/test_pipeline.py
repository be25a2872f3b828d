import random

import pytest
from corpus import SCHEMA, sentence

import corpus_pipeline
from opsframe.llm.simhash import simhash_groups

RUDE = ["blockhead", "nincompoop", "dunderhead", "scoundrel"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents with planted copies, near copies, toxic texts, repeated passages, benchmark passages and odd rows."""
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("sf"))
    clean = [(k, sentence(rng, rng.randint(80, 200))) for k in range(400)]
    toxic = []
    for k in range(400, 500):
        w = sentence(rng, 150).split()
        for _ in range(15):
            w[rng.randrange(150)] = rng.choice(RUDE)
        toxic.append((k, " ".join(w)))
    passage = sentence(rng, 70)
    planted = [(500 + k, f"{sentence(rng, 60)} {passage} {sentence(rng, 60)}") for k in range(4)]
    items = [(k, sentence(rng, 30)) for k in range(5)]
    leaking = [(510 + k, f"{sentence(rng, 60)} {t} {sentence(rng, 60)}") for k, t in items]
    copies = [(520 + k, clean[k][1]) for k in range(10)]
    odd = [(600, None), (601, ""), (602, "few words"), (None, sentence(rng, 90)), (603, sentence(rng, 30_000))]
    rows = clean + toxic + planted + leaking + copies + odd + [clean[20], clean[20]]
    full = [(k, t, "en", f"src{(k or 0) % 3}", len(t) if t is not None else None, *[None] * 6) for k, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
    labels = [(k, 0) for k, _ in clean] + [(k, 1) for k, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passage, {"toxic": toxic, "planted": planted, "leaking": leaking, "copies": copies, "clean": clean}


def test_stages(spark, folder):
    path, passage, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "mixing":
            assert out.columns == corpus_pipeline.COLUMNS
        step = f"{path}/{name}"
        out.write.parquet(step)
        before, docs = docs, spark.read.parquet(step)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
        ids = set(seen[name])
        if name == "toxicity":
            assert len([k for k, _ in rows["toxic"] if k in ids]) <= 5 and len([k for k, _ in rows["clean"] if k in ids]) >= 392
        if name == "near_duplicates":
            want = {r.doc_id for r in simhash_groups(before).where("doc_id <=> component_id").collect()}
            assert ids == want and docs.count() == len(ids) and not ids & {k for k, _ in rows["copies"] if k - 520 in ids}
        if name == "repeated_passages":
            assert docs.count() == before.count()
            assert sum(passage in (t or "") for t in seen[name].values()) == 0
            untouched = {k for k, t in rows["clean"] if seen[name].get(k) == t}
            assert len(untouched) >= 390
        if name == "benchmark_leaks":
            assert not ids & {k for k, _ in rows["leaking"]}
            assert set(seen["repeated_passages"]) - ids <= {k for k, _ in rows["leaking"]}
    assert docs.columns == [*corpus_pipeline.COLUMNS, "copies", "taken"] and docs.where("copies < 1").count() == 0


def test_empty_tables(spark, folder, tmp_path):
    path, _, _ = folder
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "benchmark_leaks", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None

import random
import zlib

from corpus import documents, empty, sentence

from opsframe.llm import toxicity as toxicity_module
from opsframe.llm.toxicity import drop_toxic, fit, toxicity, train, windows

RUDE = ["blockhead", "nincompoop", "dunderhead", "scoundrel"]


def text(rng, toxic):
    words = [rng.choice(["ba", "ko", "lim", "tor", "the", "of", "en"]) + rng.choice(["", "ner", "li", "sto"]) for _ in range(rng.randint(60, 300))]
    for _ in range(len(words) // 25 * toxic):
        words[rng.randrange(len(words))] = rng.choice(RUDE)
    return " ".join(words)


def corpus(spark, n=700):
    rng = random.Random(8)
    rows = [(k, text(rng, k % 5 == 1), int(k % 5 == 1)) for k in range(n)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), rows


def test_held_out_accuracy(spark):
    docs, labels, rows = corpus(spark)
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    out = [(got[k], y) for k, _, y in rows if got[k].held_out]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, _, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert sum(r.predicted == y for r, y in out) / len(out) > 0.95
    kept = {r.doc_id for r in drop_toxic(docs, labels).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}


def test_odd_rows(spark):
    docs, labels, _ = corpus(spark, 200)
    mixed = docs.unionByName(documents(spark).selectExpr("doc_id + 1000 as doc_id", "text"))
    odd = labels.union(spark.createDataFrame([(None, 1), (3, None), (1004, 7), (5, 1)], "doc_id long, toxic int"))
    got = toxicity(mixed, odd)
    assert got.count() == mixed.count() and got.where("score is null").count() == 0
    assert got.where("doc_id in (1000, 1001, 1002)").select("score").distinct().collect() == [(0.0,)]
    assert toxicity(empty(spark), labels).count() == 0
    assert toxicity(docs, labels.limit(0)).select("score").distinct().collect() == [(0.0,)]
    assert drop_toxic(documents(spark), labels).columns == documents(spark).columns


def test_windows_cover_the_text():
    rng = random.Random(1)
    x = sentence(rng, 400).encode()
    cut = windows(x)
    n = next(i for i in range(1, len(cut) + 1) if b"".join(cut[:i]) == x)
    assert x.endswith(b"".join(cut[n:])) and all(len(w) <= 64 for w in cut)
    assert windows(b"") == [] and b"".join(windows(b"z" * 500)) == b"z" * 500
    assert fit([], []) == 0.0


def test_training_is_bounded_by_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity_module, "fit", lambda t, o: seen.append((t, o)) or fit(t, o))
    monkeypatch.setattr(toxicity_module, "MAX_TOXIC", 5)
    monkeypatch.setattr(toxicity_module, "MAX_ORDINARY", 9)
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    rows = [(ids[0], f"row {k} of one id") for k in range(3000)] + [(k, f"text of {k}") for k in ids[1:]] + [(ids[1], f"text of {ids[1]}")] * 3000
    rows += [(ids[2], None), (ids[3], ""), (None, "no id")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(k, int(n % 2 == 0)) for n, k in enumerate(ids)], "doc_id long, toxic int")
    train(docs, labels)
    monkeypatch.setattr(toxicity_module, "MAX_BYTES", 30)
    train(docs, labels)
    (t, o), (t_small, o_small) = seen
    assert len(t) <= 5 and len(o) <= 9 and len(set(t)) == len(t) and len(set(o)) == len(o)
    whole = {b.encode() for _, b in rows if b}
    assert {*t, *o, *t_small, *o_small} <= whole and sum(map(len, t_small)) <= 30 and 0 < sum(map(len, o_small)) <= 30
    train(docs.limit(0), labels)
    assert seen[-1] == ([], [])

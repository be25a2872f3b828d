import numpy as np
from corpus import documents, empty

from opsframe.llm import mixing
from opsframe.llm.common import materialise
from opsframe.llm.mixing import flight, land, mix, source_targets, take


def test_targets_stop_at_the_limit_and_are_reshared():
    got = source_targets([("b", 100), ("a", 10), (None, 1000), ("c", 0)], (5.0, 2.0, 1.0), 3.0)
    # a (weight 5) stops at 30, c (1) at 0; null takes weight 5 again
    assert got["a"] == 30 and got["c"] == 0
    assert abs(sum(got.values()) - 1110) < 1e-9
    assert abs(got[None] / got["b"] - 5 / 2) < 1e-9 or got["b"] == 300
    assert source_targets([], (1.0,), 3.0) == {}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(500), rng.integers(0, 900, 500).astype(float)
    q = flight(p, size, np.arange(500, dtype=np.uint64), 3)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3
    final = land(q, size)
    assert set(final) <= {0.0, 1.0} and abs((final * size).sum() - (p * size).sum()) < 30
    means = np.mean([flight(np.full(60, 0.3), size[:60], np.arange(60, dtype=np.uint64), s) for s in range(400)], axis=0)
    assert abs(means.mean() - 0.3) < 0.01 and np.abs(means - 0.3).max() < 0.15


def test_mix(spark):
    docs = documents(spark)
    for group in (2000, 3):
        rows = mix(docs, group=group).collect()
        assert len(rows) == docs.count()
        assert all(r.taken == r.copies * r.size and r.taken <= 3 * r.size for r in rows)
        assert sorted(map(str, rows)) == sorted(map(str, mix(docs.repartition(5), group=group).collect()))
    by = {}
    for r in rows:
        by.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    assert all(abs(t - got) <= 0.35 * t + 400 for t, got in by.values())


def test_take(spark):
    docs = documents(spark)
    got = take(docs)
    assert got.columns == [*(c for c in docs.columns if c != "copies"), "copies", "taken"]
    shares = mix(docs)
    assert got.count() == shares.where("copies > 0").count()
    assert got.groupBy().sum("taken").first()[0] == shares.groupBy().sum("taken").first()[0]
    assert take(empty(spark)).count() == 0 and mix(empty(spark)).count() == 0


def test_totals_of_a_whole_table_are_near_independent_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(k, f"s{rng.integers(4)}", "w " * int(rng.integers(0, 120))) for k in range(3000)] + [(9000 + k, None, "one two three") for k in range(40)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).toPandas()
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len(t.split())
    order, target, total = [*sorted(s for s in size if s), None], {}, sum(size.values())
    while True:  # by the definition: shares of what is left, sources above three times their size stop there
        weigh = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order) if s not in target}
        left = total - sum(target.values())
        over = [s for s in weigh if left * weigh[s] / sum(weigh.values()) > 3 * size[s]]
        target |= {s: 3 * size[s] for s in over} if over else {s: left * w / sum(weigh.values()) for s, w in weigh.items()}
        if not over:
            break
    own = {k: s for k, s, _ in rows}
    taken = got.groupby(got.doc_id.map(own).fillna("null")).taken.sum()
    for s, t in target.items():
        assert abs(taken[s or "null"] - t) <= 60, (s, taken[s or "null"], t)
    assert (got.taken <= 3 * got["size"]).all() and len(got) == len(rows)


def test_many_equal_rows_are_one_document_of_the_flight(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mixing, "materialise", lambda df, name: seen.append(name) or materialise(df, name))
    rows = [(7, "a", "same words here", 1)] * 6000 + [(k, "b", "w " * (k % 50), 2) for k in range(500)] + [(None, None, None, 3)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copies long").repartition(6)
    got = mix(docs, group=100)
    plain = sorted(map(str, got.collect()))
    assert len(plain) == len(rows)
    equal = got.where("doc_id = 7 and size = 3").toPandas()
    assert equal.copies.max() - equal.copies.min() <= 1 and abs(equal.taken.sum() - equal.target.iloc[0]) <= 3
    before = spark.conf.get("opsframe.hotRows", None)
    spark.conf.set("opsframe.hotRows", "500")
    try:
        assert sorted(map(str, mix(docs, group=100).collect())) == plain and "hot" in seen
        kept = take(docs)
        assert kept.groupBy().sum("taken").first()[0] == mix(docs).groupBy().sum("taken").first()[0]
    finally:
        spark.conf.unset("opsframe.hotRows") if before is None else spark.conf.set("opsframe.hotRows", before)

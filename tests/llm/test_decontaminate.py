import random
from collections import Counter
from math import log

from corpus import documents, empty, sentence

from opsframe.llm import decontaminate
from opsframe.llm.decontaminate import drop_leaks, leaks, words_of

ITEM = "item_id long, text string, doc_id long"


def brute(docs, items, threshold=0.8):
    items = [(i, words_of(t)) for i, t in items if len(words_of(t)) >= 5]
    held = Counter(s for _, w in items for s in {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    weigh = lambda s: 1 + log(len(items) / held[s]) if s in held else 1 + log(len(items) + 1)
    out = {}
    for doc, text in docs:
        words = words_of(text)
        for item, own in items:
            b = Counter(tuple(own[k : k + 5]) for k in range(len(own) - 4))
            for p in range(len(words) - len(own) + 1):
                a = Counter(tuple(words[k : k + 5]) for k in range(p, p + len(own) - 4))
                if not a.keys() & b.keys():
                    continue
                keys = a.keys() | b.keys()
                s = sum(weigh(x) * min(a[x], b[x]) for x in keys) / sum(weigh(x) * max(a[x], b[x]) for x in keys)
                if s >= threshold and s > out.get((doc, item), (0,))[0] + 1e-12:
                    out[doc, item] = (s, p)
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", 400)  # short parts, so that windows cross them
    rng = random.Random(6)
    items = [(k, sentence(rng, rng.choice([6, 20, 41, 60]))) for k in range(14)] + [(50, "too short"), (51, None), (52, "")]
    items += [(53, items[2][1]), (54, items[3][1])]
    docs = [(k, sentence(rng, rng.randint(0, 150))) for k in range(10)]
    for k, (_, t) in enumerate(items[:14]):
        w = t.upper().split()
        if k % 3 == 1 and len(w) > 25:
            w[len(w) // 2] = "changed"
        if k % 3 == 2:
            del w[: len(w) // 3]
        docs.append((100 + k, f"{sentence(rng, rng.randint(0, 90))}. {', '.join(w)}! {sentence(rng, 30)}"))
    docs += [docs[10], (300, None), (None, items[0][1]), (301, " ".join([sentence(rng, 500), items[5][1], items[0][1]]))]
    df = spark.createDataFrame([(a, b, 3) for a, b in docs], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], ITEM)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in leaks(df, bench).collect()}
    assert got == {k: (round(s, 9), p) for k, (s, p) in brute(docs, items).items()}
    monkeypatch.setattr(decontaminate, "SLICE", 4)
    assert {(r.doc_id, r.item_id) for r in leaks(df, bench).collect()} == set(got)
    kept = drop_leaks(df, bench)
    leaking = {d for d, _ in got}
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in leaking)


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "five words are enough here", 2)], ITEM)
    assert leaks(empty(spark), bench).count() == 0
    assert leaks(documents(spark), bench.limit(0)).count() == 0
    assert drop_leaks(documents(spark), bench.limit(0)).count() == documents(spark).count()


def test_only_leaking_rows_go(spark):
    rng = random.Random(14)
    item, clean, other = sentence(rng, 20), sentence(rng, 60), sentence(rng, 60)
    bench = spark.createDataFrame([(1, item, 2)], ITEM)
    leaking = f"{sentence(rng, 30)} {item} {sentence(rng, 30)}"
    rows = [(None, clean), (None, leaking), (None, other), (None, None), (7, clean), (7, leaking), (7, other), (7, other)]
    kept = drop_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(str(r) for r in rows if r[1] != leaking)


def test_item_longer_than_a_part(spark):
    rng = random.Random(15)
    long_, short = sentence(rng, decontaminate.PART + 100), sentence(rng, 20)
    bench = spark.createDataFrame([(0, long_, 1), (1, short, 1)], ITEM)
    border = f"{sentence(rng, decontaminate.PART - 10)} {short}"
    crossing = f"{sentence(rng, 2 * (decontaminate.PART + 99) - 10)} {short} {long_} {sentence(rng, 50)}"
    rows = [(1, border), (2, f"{sentence(rng, 70)} {long_}"), (3, crossing)]
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    at = len(crossing.split()) - 50 - len(long_.split())
    assert got == {(1, 1): (1.0, decontaminate.PART - 10), (2, 0): (1.0, 70), (3, 1): (1.0, at - 20), (3, 0): (1.0, at)}


def test_short_items_are_searched_as_whole_sequences(spark):
    bench = spark.createDataFrame([(1, "Forty-two", 0), (2, "blue", 0), (3, "deep blue sea", 0), (4, "deep blue sea", 0), (5, "...", 0),
                                   (6, "one two three four five six", 0)], ITEM)
    rows = [(1, "it is forty two, no more"), (2, "the deep, blue sea"), (3, "deep sea"), (4, None), (5, "..."), (6, "Blue"), (7, "forty three")]
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1): (1.0, 2), (2, 2): (1.0, 2), (2, 3): (1.0, 1), (2, 4): (1.0, 1), (6, 2): (1.0, 0)}
    assert {r.doc_id for r in drop_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()} == {3, 4, 5, 7}

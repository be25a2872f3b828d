import itertools
import random
import re

import xxhash
from corpus import documents, empty, sentence

from opsframe.llm.simhash import covering_masks, keep_one, links, simhash_groups


def brute_print(text, shingle=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 3):
        masks = [m & (2**64 - 1) for m in covering_masks(radius)]
        rng = random.Random(3)
        for _ in range(3000):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any(not diff & m for m in masks)


def test_groups_against_brute_force(spark):
    docs = documents(spark)
    prints = {(r.doc_id, r.text): brute_print(r.text) for r in docs.collect()}
    pairs = [(a, b) for a, b in itertools.combinations(set(prints.values()), 2) if (a ^ b).bit_count() <= 3]
    group = groups_of(pairs, set(prints.values()))
    first = {}
    for (doc, _), fp in prints.items():
        if doc is not None:
            first[group[fp]] = min(doc, first.get(group[fp], doc))
    want = sorted((str(d), f"{fp:016x}", str(first.get(group[fp]))) for (d, _), fp in prints.items())
    got = simhash_groups(docs)
    assert got.count() == docs.count()
    assert sorted({(str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()}) == sorted(set(want))
    assert simhash_groups(empty(spark)).count() == 0


def test_large_buckets_are_cut(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(63)
    prints = list({centre ^ sum(1 << b for b in rng.sample(range(63), 2)) for _ in range(400)} | {rng.getrandbits(63) for _ in range(50)})
    edges = links(spark.createDataFrame([(p,) for p in prints], "fp long"), 3, chunk=20).collect()
    brute = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 3]
    assert groups_of([(r.a, r.b) for r in edges], prints) == groups_of(brute, prints)
    assert all((r.a ^ r.b) >= 0 for r in edges)


def test_one_of_each_group_stays(spark):
    docs = documents(spark)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in simhash_groups(docs).where("doc_id <=> component_id").select("doc_id").distinct().collect()]
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in kept.collect())
    assert keep_one(empty(spark)).count() == 0


def test_groups_keep_a_row_whatever_their_ids(spark):
    rng = random.Random(13)
    a, b, c, d, e = (sentence(rng, 80) for _ in range(5))
    # unrelated texts without an id and under one id; a copy under the id of a kept row
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, c), (8, e), (8, e.upper()), (9, a)]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((str(r.doc_id), r.text.lower()) for r in kept)) == sorted([("9", a), ("None", b), ("7", c), ("7", d), ("8", e)])

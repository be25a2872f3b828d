import random

import pytest
from corpus import documents, empty, sentence

from opsframe.llm.license_scan import BANDS, TEMPLATES, scan, template_words, variants


def shingles(words):
    return [" ".join(words[k : k + 5]) for k in range(len(words) - 4)]


def brute(docs, templates):
    own = {name: set(shingles(template_words(t))) for name, t in templates.items()}
    kin, out = variants(own), {}
    for doc, text in docs:
        sh = shingles(template_words(text or ""))
        for name, t in templates.items():
            size = len(shingles(template_words(t)))
            stride = max(1, size // 4)
            for s in range(0, max(len(sh) - size, 0) + 1, stride):
                near = set(sh[max(0, s - stride) : s + size + stride])
                if len(own[name] & near) / len(own[name]) >= 0.8:
                    share, best = min((-len(own[k] & near) / len(own[k]), k) for k in kin[name])
                    out[doc, best] = max(out.get((doc, best), 0), round(-share, 6))
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    docs = []
    for k, (_, t) in enumerate(TEMPLATES.items()):
        docs.append((k, f"{sentence(rng, rng.randint(0, 60))} {t.upper()} {sentence(rng, 20)}"))
        w = t.split()
        w[len(w) // 2] = "other"
        docs.append((100 + k, f"{sentence(rng, 33)}\n{' '.join(w)}"))
        docs.append((200 + k, " ".join(t.split()[: len(t.split()) // 2])))
    docs += [(500, " ".join(TEMPLATES.values())), (501, sentence(rng, 20_000) + " " + TEMPLATES["mit-permission"]), docs[0], docs[0], (None, TEMPLATES["mit-notice"])]
    df = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, window long, license string")
    got = {(r.doc_id, r.license): r.containment for r in scan(df).collect()}
    assert got == brute(docs, TEMPLATES)


GNU = ["gpl-2.0-header", "gpl-3.0-header", "lgpl-2.0-header", "lgpl-2.1-header", "lgpl-3.0-header", "agpl-3.0-header"]


def test_versions_of_a_licence_are_told_apart(spark):
    rng = random.Random(9)
    docs = []
    for k, name in enumerate(GNU):
        for j, subject in enumerate(["This program", "This library", "It"]):
            docs.append((10 * k + j, f"{sentence(rng, 7 * j + k)} {subject} {TEMPLATES[name]} {sentence(rng, 30)}"))
    unknown = TEMPLATES["gpl-3.0-header"].replace("version 3", "version 99")
    docs += [(100, f"The file {unknown}"), (101, f"{TEMPLATES['gpl-2.0-header']} {sentence(rng, 60)} {TEMPLATES['agpl-3.0-header']}")]
    docs += [(102, f"{sentence(rng, 9)} {TEMPLATES['gpl-2.0-only-header']}"), (103, TEMPLATES["cc-by-sa-4.0-notice"]), (104, TEMPLATES["epl-1.0-header"])]
    got = {(r.doc_id, r.license) for r in scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {(10 * k + j, name) for k, name in enumerate(GNU) for j in range(3)}
    want |= {(100, "gpl-2.0-header"), (101, "gpl-2.0-header"), (101, "agpl-3.0-header"), (102, "gpl-2.0-only-header"), (103, "cc-by-sa-4.0-notice"), (104, "epl-1.0-header")}
    assert got == want


def test_odd_rows(spark):
    assert scan(documents(spark)).count() == 0
    assert scan(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        scan(documents(spark), {"x": "too few words"})


def test_no_python_in_the_plan(spark):
    plan = scan(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert (1 - 0.3 / 1.7) ** BANDS < 0.001 and (1 - 1 / 3) ** BANDS < 1e-8  # misses at the least and at half of the shingles shared

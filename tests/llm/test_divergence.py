import random
import re
from collections import Counter, defaultdict

import numpy as np
from corpus import documents, empty

from opsframe.llm import divergence as module
from opsframe.llm.common import pieces
from opsframe.llm.divergence import divergence, skyband

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=30, top=50):
    """rows: (text, lang, source)."""
    count, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        found = [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        count[lang, source].update(found)
        in_docs[lang].update(set(found))
    out, share = [], {}
    for lang, source in groups:
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]
        sources = [s for a, s in groups if a == lang]

        def shares(counts, kept=tuple(kept)):
            total = sum(counts[x] for x in kept)
            return {t: 1 + 1000000000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        if (lang, source) not in share:
            share.update({(lang, s): shares(count[lang, s]) for s in sources})
            share[lang] = shares(sum((count[lang, s] for s in sources), Counter()))
        mine, whole = share[lang, source], share[lang]
        pairs = [(-sum(abs(mine[t] - share[lang, s][t]) for t in kept), s.encode()) for s in sources if s != source]
        terms = [(whole[t] - mine[t], t.encode()) for t in kept if count[lang, source][t] and mine[t] > whole[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out += [(lang, source, part, item.decode(), -f, n + 1) for n, (f, item) in enumerate(items)]
    return sorted(out)


def result(df, **options):
    got = divergence(df, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, got.collect()))


def corpus(seed, n, sources, vocabulary=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßΩ") for _ in range(rng.randint(1, 5))) for _ in range(vocabulary)]
    weights = [[rng.choice([1, 1, 1, 30]) for _ in words] for _ in range(sources)]
    out = []
    for _ in range(n):
        s = rng.randrange(sources)
        text = " ".join(rng.choices(words, weights[s], k=rng.randint(0, 30)))
        out.append((text.upper() if rng.random() < 0.2 else text, rng.choice(["en", "de"]), f"s{s}"))
    return out


def test_against_brute_force(spark):
    rows = corpus(1, 900, 6) + [(None, "en", "s1"), ("", "xx", "only"), ("a b", None, None), ("a", "", "s0"), ("one_two3four\x00five", "en", None)]
    rows += [rows[0]] * 3
    df = spark.createDataFrame([(a, b, c, "x", 1, 2, "y") for a, b, c in rows], "text string, lang string, source string, term string, n long, p long, part string")
    assert result(df) == brute(rows)
    assert result(df, min_docs=2, top=3) == brute(rows, 2, 3)


def test_more_sources_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(module, "BUCKET", 40)
    rows = corpus(2, 1200, 150, 120)
    assert len({s for _, lang, s in rows if lang == "en"}) > module.SIDE
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert result(df) == brute(rows)


def test_merged_bands(spark, monkeypatch):
    """Many merge rounds and small holds change nothing."""
    monkeypatch.setattr(module, "MERGED", 40)
    monkeypatch.setattr(module, "BAND", 10)
    monkeypatch.setattr(module, "HELD", 50)
    rows = corpus(3, 800, 3, 800)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(12)
    assert result(df, min_docs=3) == brute(rows, 3)


def test_odd_documents(spark):
    odd = [(r.text, r.lang, r.source) for r in documents(spark).collect()]
    assert result(documents(spark), min_docs=2) == brute(odd, 2)
    assert result(empty(spark)) == []
    assert {r[2] for r in result(documents(spark), min_docs=10**6)} == {"pair"}


def test_skyband_is_what_few_dominate():
    rng = np.random.default_rng(1)
    for k in (1, 3, 50):
        n, base = rng.integers(0, 40, 700), rng.integers(0, 40, 700)
        term = np.array([f"t{x:04d}" for x in rng.permutation(700)], dtype=object)
        want = [i for i in range(700) if ((n >= n[i]) & (base <= base[i]) & (term < term[i])).sum() < k]
        assert sorted(skyband(n, base, term, k).tolist()) == want
        best = np.lexsort((term, base - n))[:k]
        assert set(best.tolist()) <= set(want)


def test_pieces_make_the_whole_text():
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice("abcéΩ .\n") for _ in range(rng.randint(0, 200))).encode()
        assert b"".join(pieces(text, 7)) == text
        assert [t for p in pieces(text, 7) for t in module._TERM.findall(p)] == module._TERM.findall(text)

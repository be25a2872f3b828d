import random
import re
import zlib
from collections import Counter

from corpus import SCHEMA, documents, empty, texts

from opsframe.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, min_length=6, min_count=5, ratio=5):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= min_length:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= min_count}
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def result(df, **options):
    got = spelling.variants(df, **options)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, got.collect()))


def noisy(seed, n, alphabet="abé"):
    """Texts over few letters, so that words have many near ones, with runs of equal letters."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 8))) for _ in range(260)]
    weights = [rng.choice([4, 4, 20, 100, 600]) for _ in base]
    return [(k, " ".join(rng.choices(base, weights, k=rng.randint(0, 80)))) for k in range(n)]


def test_against_brute_force(spark):
    rows = noisy(1, 400) + [(9, None), (10, ""), (None, "Abcdef ABCDEF abcdef abcdeÉ abcdeé"), (7, "straße×÷ŁstraßeĀ " * 6), (None, "aaaaaa " * 9 + "aaaaaaa " * 60)]
    rows += [rows[0], rows[0], (8, "letterx " * 5 + "letters " * 30 + "lettersy " * 200)]
    df = spark.createDataFrame([(a, b, "x", 1, 2, 3) for a, b in rows], "doc_id long, text string, word string, n long, nodes int, own int")
    want = brute(rows)
    assert len(want) > 40 and any(r[2] not in (r[0], r[1]) for r in want)
    assert result(df) == want


def test_lost_code_points(spark):
    rows = [(k, f"wordforms spelling Überfluß {'zzzzzzz' if k % 2 else 'qzzzzzz'}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert any(r[1] for r in want)
    assert result(df) == want


def test_ranges_share_nodes(spark, monkeypatch):
    """Words of one range and of many give the same."""
    rows = noisy(2, 300, "ab")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(spelling, "PER_TASK", 1)
    assert result(df) == brute(rows)


def test_long_words_and_odd_documents(spark):
    long_ = "ab" * 30_000
    rows = [(k, f"{long_} {long_}x {long_[1:]}") for k in range(6)] + [(k, long_) for k in range(10, 40)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(len(w), n, near, len(f or "")) for w, f, _, n, near, _ in got if n >= 6] == [  # one document loses a code point
        (60_000, 35, 2, 0), (60_001, 6, 1, 60_000), (59_999, 6, 1, 60_000)]
    odd = [(r.doc_id, r.text) for r in documents(spark).collect()]
    assert len(odd) > len(texts()) and "doc_id" in SCHEMA
    assert result(documents(spark), min_count=2) == brute(odd, min_count=2)
    assert result(empty(spark)) == []
    assert result(documents(spark), min_count=10**9) == []

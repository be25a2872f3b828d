import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus import documents, empty, sentence

from opsframe.llm.suffix_dedup import dedup_bytes, front_code, front_decode, loser_tree_merge, without_repeats


def brute(texts, width):
    starts = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if starts[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("run_size, range_size", [(60_000, 400_000), (250, 700)])
def test_against_brute_force(spark, run_size, range_size):
    docs = documents(spark)
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    long_ = max(texts, key=len)
    want = Counter((str(r.doc_id), *w[:4]) for r, w in zip(rows, brute(texts, 200)))
    got = dedup_bytes(docs, run_size=run_size, range_size=range_size)
    assert Counter((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert len(long_) > 300_000  # longer than a block


def test_hot_passage_in_many_contexts(spark):
    """Classes that several runs share go through the exchange and the loser tree."""
    rng = random.Random(2)
    passage = sentence(rng, 45)
    rows = [(k, f"{sentence(rng, 12)} {passage} {sentence(rng, 12)}" + (" tail" if k % 2 else "")) for k in range(120)]
    rows += [(200, "x" * 450), (201, "ab" * 220)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(k, *w[:4]) for (k, _), w in zip(rows, brute([t.encode() for _, t in rows], 200))]
    got = dedup_bytes(docs, run_size=500, range_size=2000)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert any(w[2] for w in want)


def test_front_coding_and_merge():
    rng = random.Random(4)
    rows = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)]
    runs, parts = [], [sorted(set(rows[k::7])) for k in range(7)]
    for p in parts:
        m = np.frombuffer(b"".join(p), dtype=np.uint8).reshape(len(p), 12)
        shared, rest = front_code(m)
        assert list(front_decode(shared, rest, 12)) == p
        runs.append((shared, rest, np.arange(len(p))))
    merged = [(s, parts[r][k]) for s, r, k in loser_tree_merge(runs, 12)]
    assert [x for _, x in merged] == sorted(x for p in parts for x in p)
    for (s, x), (_, before) in zip(merged[1:], merged):
        assert s == next((i for i in range(12) if x[i] != before[i]), 12)


def test_texts_without_repeats(spark):
    docs = documents(spark)
    got = without_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = docs.collect()
    want = Counter(
        (str(r.doc_id), None if r.text is None else w[4].decode(errors="ignore"))
        for r, w in zip(rows, brute([(r.text or "").encode() for r in rows], 200)))
    assert Counter((str(r.doc_id), r.text) for r in got.collect()) == want
    assert dedup_bytes(empty(spark)).count() == 0 and without_repeats(empty(spark)).count() == 0


def same_crc(text, places):
    """Another text of the same length and CRC-32, by turning some letters a into c at ``places``."""
    plain, basis = zlib.crc32(text), {}
    for k, at in enumerate(places):
        turned = bytearray(text)
        turned[at] ^= 2
        value, used = zlib.crc32(bytes(turned)) ^ plain, 1 << k
        while value and value.bit_length() in basis:
            other, mask = basis[value.bit_length()]
            value, used = value ^ other, used ^ mask
        if not value:  # these changes cancel each other in the checksum
            out = bytearray(text)
            for j, p in enumerate(places):
                if used >> j & 1:
                    out[p] ^= 2
            return bytes(out)
        basis[value.bit_length()] = (value, used)
    raise AssertionError("too few places")


def test_rows_without_ids_and_with_equal_checksums(spark):
    """Different texts under one id are told apart, whatever their CRC-32."""
    rng = random.Random(9)
    text = "".join(sentence(rng, 6) + " a " for _ in range(60))
    places = [k + 1 for k in range(len(text)) if text[k : k + 3] == " a "]
    other = same_crc(text.encode(), places)
    assert zlib.crc32(text.encode()) == zlib.crc32(other) and text.encode() != other
    rows = [(None, text), (None, other.decode()), (5, text[:900]), (None, sentence(rng, 80)), (5, sentence(rng, 80))]
    want = sorted(str((k, *w[:4])) for (k, _), w in zip(rows, brute([t.encode() for _, t in rows], 200)))
    got = dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(str(tuple(r)) for r in got.collect()) == want

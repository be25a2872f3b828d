import math

import numpy as np
import pytest

from opsframe.llm import top_k as module
from opsframe.llm.top_k import Best, Chunk, cover_tree, farthest_first, products, search, top_k


def brute(rows, k=5, every=50):
    """rows: (id, vector); scores in Python's whole numbers."""
    good = []
    for at, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((at, i, [math.floor(256 * x) for x in v]))
    out = []
    for at, i, q in good:
        if i is None or i % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v)), (j is None, j or 0)) for other, j, v in good if other != at)[:k]
        out += [(i, n + 1, None if missing else j, -s) for n, (s, (missing, j)) in enumerate(found)]
    return sorted(map(str, out))


def result(df, **options):
    got = top_k(df, **options)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(str(tuple(r)) for r in got.collect())


def clustered(rng, n, dims=8, groups=12):
    centres = rng.normal(size=(groups, dims))
    return [(centres[k % groups] + rng.normal(scale=0.05, size=dims)).astype(np.float32).tolist() for k in range(n)]


@pytest.mark.parametrize("kind, chunk", [("float", 16_384), ("double", 60)])
def test_against_brute_force(spark, monkeypatch, kind, chunk):
    monkeypatch.setattr(module, "CHUNK", chunk)
    monkeypatch.setattr(module, "SLICE", 2)
    rng = np.random.default_rng(4)
    vectors = clustered(rng, 400)
    vectors += [vectors[0]] * 9 + [vectors[3][:5], [], [0.0] * 8, vectors[7] + [3.0], [-x for x in vectors[2]]]
    odd = [None, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7]
    rows = [(10 * k, v) for k, v in enumerate(vectors + odd)]
    rows += [rows[5], rows[5], rows[5], (None, vectors[20]), (None, vectors[25]), (None, None), (-50, vectors[30])]
    df = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], f"vec_id long, embedding array<{kind}>, rank int, score int, row int")
    assert result(df) == brute(rows)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert result(spark.createDataFrame([], schema)) == []
    assert result(spark.createDataFrame([(50, None), (1, [1.0])], schema)) == []
    assert result(spark.createDataFrame([(50, [1.0, 2.0])], schema)) == []
    rows = [(50, [1.0, 2.0]), (100, [0.5, 0.5]), (7, [0.5, 0.5])]
    assert result(spark.createDataFrame(rows, schema)) == brute(rows)
    assert result(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema)) == []


def test_one_vector_many_times(spark):
    """Equal vectors are one entry; a query still finds other rows of its own vector, smallest ids first."""
    rows = [(k, [0.25, -0.5]) for k in range(3000)] + [(k, [0.3, 0.1]) for k in range(3000, 3300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = result(df)
    assert len(got) == 66 * 5 and "(0, 1, 1, 20480)" in got and "(50, 1, 0, 20480)" in got
    assert got == brute(rows)


def test_nodes_cover_their_rows():
    rng = np.random.default_rng(6)
    x = np.floor(256 * np.array(clustered(rng, 900)))
    x = np.concatenate([x, x[:3].repeat(300, axis=0)])
    order, nodes, radii = cover_tree(x, 32)
    assert sorted(order.tolist()) == list(range(len(x)))
    y = x[order]
    for (lo, hi, mid, first, end), radius in zip(nodes.tolist(), radii.tolist()):
        assert lo <= mid < hi
        assert np.sqrt(((y[lo:hi] - y[mid]) ** 2).sum(axis=1)).max() <= radius + 1e-9
        if first < end:
            assert [a for a, *_ in nodes[first:end].tolist()] == [lo, *[b for _, b, *_ in nodes[first : end - 1].tolist()]] and nodes[end - 1][1] == hi
        else:
            assert hi - lo <= 32 or radius == 0
    centres, owner = farthest_first(x, 16)
    gap = min(np.sqrt(((x[a] - x[b]) ** 2).sum()) for a in centres for b in centres if a != b)
    assert np.sqrt(((x - x[centres[owner]]) ** 2).sum(axis=1)).max() <= gap + 1e-9


def test_nodes_far_away_are_pruned():
    rng = np.random.default_rng(7)
    x = np.floor(256 * np.array(clustered(rng, 6000, groups=24)))
    order, nodes, radii = cover_tree(x)
    n = np.arange(len(x))
    chunk = Chunk(x[order], nodes, radii, np.arange(len(x) + 1), n, n)
    queries = x[::24][:64]
    best = Best(len(queries), 6)
    done = search(queries, chunk, best)
    assert done < 0.2 * len(queries) * len(x)
    scores = products(queries, chunk.x)
    for q in range(len(queries)):
        want = sorted(zip((-scores[q]).tolist(), n.tolist()))[:6]
        assert list(zip((-best.score[best.query == q]).tolist(), best.id[best.query == q].tolist())) == want


def test_large_parts_stay_exact():
    x = np.array([[2.0**40, 1.0, 3.0]])
    assert products(x, np.array([[2.0**20, 5.0, -1.0]])).tolist() == [[2**60 + 2]]
    with pytest.raises(OverflowError):
        products(x, x)

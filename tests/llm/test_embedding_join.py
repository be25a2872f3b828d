import numpy as np
import pytest

from opsframe.llm.embedding_join import near_duplicates, near_pairs, unit


def brute(rows, threshold=0.9):
    good = [
        (k, np.array(v, dtype=np.float64)) for k, (_, v) in enumerate(rows)
        if v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in good:
        for j, b in good:
            if i < j and len(a) == len(b) and (unit(a[None]) @ unit(b[None]).T)[0, 0] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    first = {}
    for k, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            first[find(k)] = min(vec_id, first.get(find(k), vec_id))
    return sorted(str((v, links[k], first.get(find(k)), v == first.get(find(k)))) for k, (v, _) in enumerate(rows))


@pytest.mark.parametrize("kind, block", [("float", 2048), ("double", 7)])
def test_against_brute_force(spark, kind, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    vectors = [(c + rng.normal(scale=0.16, size=8)).astype(np.float32).tolist() for c in centres for _ in range(12)]
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[5]], [-x for x in vectors[7]], [1e30 * x for x in vectors[9]], vectors[3][:5], vectors[3][:5]]
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [None] + [1.0] * 7]
    rows = [(k + 10, v) for k, v in enumerate(vectors + odd)]
    rows += [rows[4], rows[4], (None, vectors[20]), (None, None), (3, vectors[30])]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], f"vec_id long, embedding array<{kind}>, label int, n long")
    got = near_duplicates(df, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got.collect()) == brute(rows)


def test_empty_and_all_invalid(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert near_duplicates(df.limit(0)).count() == 0
    assert sorted(map(tuple, near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_intervals_skip_nothing():
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(300, 3)))
    x = x[np.argsort(x[:, 0])]
    i, j = near_pairs(x, x, x, x, 0.97, float(np.sqrt(0.06)), 16, True)
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.97)) if a < b}
    assert set(zip(i.tolist(), j.tolist())) == want

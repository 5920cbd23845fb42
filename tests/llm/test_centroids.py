import hashlib
import math

import numpy as np
import pytest

from offerlake.llm import centroids, queries

SF = "/root/testdata/sf0.001"


def brute_force(rows, k, rounds, dims, scale):
    """Lloyd's rounds in Python integers over (id, vector) rows that count."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    middle = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        middle = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(middle)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(middle))}
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), middle[c]) for i, c, d in found)


def got(df, dims):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in df.collect())


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_force(rows, 16, 3, 64, 64)
    found = queries.op11_centroid_clustering(spark, SF).collect()
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found) == [
        (*w[:5], digest(w[5])) for w in want
    ]


def test_ties_copies_and_odd_rows(spark):
    same = [(i, [1.0, -2.5]) for i in range(40)]
    grid = [(100 + i, [float(i % 5), float(i // 5)]) for i in range(25)]
    sound = [*same, *grid, (7, [0.26, -0.26]), (7, [9.0, 9.0])]
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("-inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1e300, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in sound + odd], "vec_id long, embedding array<double>, cluster int, distance int")
    for rounds in (0, 1, 4):
        assert got(centroids.cluster(df, k=4, rounds=rounds, dims=2, scale=4), 2) == brute_force(sound, 4, rounds, 2, 4)


def test_fewer_vectors_than_centroids_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0]), (None, [2.0]), (None, [2.0])], "vec_id long, embedding array<float>")
    found = centroids.cluster(df, k=8, dims=1).collect()
    assert len(found) == 3 and {r.inertia for r in found} == {0}
    empty = centroids.cluster(df.limit(0), k=8, dims=1)
    assert empty.count() == 0 and empty.columns == centroids.cluster(df, k=8, dims=1).columns


@pytest.mark.parametrize("spread", [0, 1, 3, 1000])
def test_bounds_give_the_assignments_of_full_scans(spread):
    random = np.random.default_rng(spread)
    v = random.integers(-50, 50, (3000, 8)) * (spread > 0) + random.integers(0, 3, (3000, 8))
    old = v[:6].copy()
    own, upper, lower = centroids.reassign(v, np.zeros(3000, np.int64), np.zeros(3000), np.zeros(3000), old, None)
    for _ in range(6):
        new = old + random.integers(-spread, spread + 1, old.shape)
        own, upper, lower = centroids.reassign(v, own, upper, lower, new, old)
        assert (own == centroids.scan(v, new)[0]).all()
        old = new


def test_bounds_save_scans(monkeypatch):
    """Far groups and still centroids: no vector is scanned again."""
    v = np.repeat(np.array([[0], [1000], [5000]]), 100, axis=0) + np.arange(300)[:, None] % 7
    start = np.array([[3], [1003], [5003]])
    state = centroids.reassign(v, np.zeros(300, np.int64), np.zeros(300), np.zeros(300), start, None)
    monkeypatch.setattr(centroids, "scan", lambda *a: pytest.fail("scanned"))
    assert (centroids.reassign(v, *state, start + 1, start)[0] == np.repeat([0, 1, 2], 100)).all()

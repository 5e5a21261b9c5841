import hashlib
import random

import numpy as np
import pytest

from driftline.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long, planes array<long>, _v string, _id long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, None, "v", 3) for i, v in rows], SCHEMA)


def plain(rows, clusters, rounds, dims=64, scale=64):
    """The contract, entry by entry."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    at = [list(v) for _, _, v in named[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at))

    for _ in range(rounds):
        mine = [nearest(v)[1] for _, v in kept]
        for k in range(len(at)):
            members = [v for (_, v), m in zip(kept, mine) if m == k]
            if members:
                at[k] = [sum(c) // len(members) for c in zip(*members)]
    found = [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept]
    out = []
    for i, k, away in found:
        own = sum(d for _, c, d in found if c == k)
        digest = hashlib.sha256(",".join(map(str, at[k])).encode()).hexdigest()
        out.append((i, k, away, own, sum(d for _, _, d in found), digest))
    return sorted(out, key=str)


def vectors(n, dims=64, seed=5):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [m + rng.gauss(0, 0.4) for m in middles[i % 4]]) for i in range(n)]


def awkward():
    rows = vectors(60)
    some = rows[7][1]
    return [
        *rows, (7, some), (None, some), (None, rows[9][1]), (100, None), (101, []), (102, some[:63]), (103, [*some, 0.0]),
        (104, [None, *some[1:]]), (105, [float("nan"), *some[1:]]), (106, [float("inf"), *some[1:]]), (107, [0.0] * 64), (108, [-0.0] * 64),
        (109, [-1.0] * 64), (110, [300.25] * 64),
    ]


@pytest.mark.parametrize("clusters, rounds", [(16, 3), (3, 0), (100, 2)])
def test_equals_plain_clustering(spark, clusters, rounds):
    rows = awkward()
    got = centroids.cluster(table(spark, rows).repartition(5), clusters=clusters, rounds=rounds)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]
    assert sorted((tuple(r) for r in got.drop("centroid").collect()), key=str) == plain(rows, clusters, rounds)


@pytest.mark.parametrize("dims", [3, 130])
def test_other_widths(spark, dims):
    rows = vectors(40, dims)
    got = centroids.cluster(table(spark, rows), clusters=5, dims=dims).drop("centroid")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 5, 3, dims)


def test_no_vectors(spark):
    assert centroids.cluster(table(spark, [])).count() == 0
    assert centroids.cluster(table(spark, [(1, None), (2, [1.0])])).count() == 0


def test_all_alike(spark):
    got = centroids.cluster(table(spark, [(i, [0.5] * 64) for i in range(40)])).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)}


def test_too_large_entries_are_refused(spark):
    with pytest.raises(Exception, match="squared distances"):
        centroids.cluster(table(spark, [(1, [1e9] * 64)])).count()


def test_planes():
    rng = np.random.default_rng(3)
    for reach in (1, 2, 100, 1 << 24):
        a, b = rng.integers(-reach, reach + 1, (2, 50, 130))
        pa, pb = (centroids.pack(x, centroids.planes_needed(x)) for x in (a, b))
        assert (centroids.unpack(pa, 130) == a).all()
        assert (centroids.dots(pa, pb) == (a * b).sum(axis=1)).all()
        assert (centroids.dots(pa, pb[7]) == a @ b[7]).all()
    for value, planes in ((0, 1), (-1, 1), (1, 2), (-2, 2), (2, 3), (-128, 8), (127, 8), (128, 9)):
        assert centroids.planes_needed(np.array([[value]])) == planes

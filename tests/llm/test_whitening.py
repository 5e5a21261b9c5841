import numpy as np
import pytest

from driftline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component int, n long, x array<long>, _v string, _id long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, None, "v", 3) for i, v in rows], SCHEMA)


def vectors(n=80, dims=6, seed=4):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) + 3
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(mixed)]


def awkward():
    rows = vectors()
    some = rows[7][1]
    return [
        *rows, (7, some), (None, some), (None, rows[9][1]), (100, None), (101, []), (102, some[:5]), (103, [*some, 0.0]),
        (104, [None, *some[1:]]), (105, [float("nan"), *some[1:]]), (106, [float("-inf"), *some[1:]]), (107, [0.0] * 6), (108, [-0.0] * 6),
        *[(200 + i, some) for i in range(60)],
    ]


def plain(rows, dims=6, scale=256):
    kept = [(i, tuple(int(np.floor(np.float64(np.float32(x)) * scale)) for x in v)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    distinct = sorted({v for _, v in kept})
    x = np.array(distinct, dtype=float)
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1].T, centred


def test_equals_plain_whitening(spark):
    kept, n, sums, values, vectors, _ = plain(awkward())
    got = whitening.whiten(table(spark, awkward()).repartition(5)).collect()
    assert len(got) == 4 * len(kept)
    by_component = {c: [r for r in got if r["component"] == c] for c in (1, 2, 3, 4)}
    for c, own in by_component.items():
        assert {r["n"] for r in own} == {n}
        assert own[0]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-10)
        sign = None
        mean = np.array(sums) / n
        want = {}
        for i, v in kept:
            want.setdefault((i, sum((n * a - s) ** 2 for a, s in zip(v, sums))), []).append((np.array(v) - mean) @ vectors[c - 1] / np.sqrt(values[c - 1]))
        for r in own:
            near = want[r["vec_id"], r["deviation"]][0]
            sign = sign or np.sign(near * r["whitened"])
            assert r["whitened"] == pytest.approx(sign * near, abs=1e-9)
    assert {r["identity_error"] for r in got}.pop() < 1e-9


def test_factors():
    rng = np.random.default_rng(1)
    for rank, dims in ((64, 64), (5, 12), (1, 3)):
        half = rng.normal(size=(dims, rank)) * 10.0 ** -np.arange(rank).clip(max=6)
        matrix = half @ half.T
        order, factor = whitening.pivoted_cholesky(matrix)
        assert factor.shape[1] <= rank and (np.triu(factor, 1) == 0).all()
        assert np.allclose(factor @ factor.T, matrix[np.ix_(order, order)], atol=1e-12 * np.abs(matrix).max())
        values, components = whitening.principal_components(matrix)
        assert np.allclose(components @ components.T, np.eye(len(values)), atol=1e-13)
        assert (np.diff(values) <= 0).all()
        assert np.allclose(values[:4], np.linalg.eigvalsh(matrix)[::-1][:4][:len(values)], rtol=1e-12, atol=1e-13 * values[0])


def test_same_bits_however_rows_are_dealt(spark):
    rows = vectors(200)
    runs = [whitening.whiten(table(spark, rows).repartition(k)).orderBy("vec_id", "component").drop("identity_error").collect() for k in (1, 3, 17)]
    assert runs[0] == runs[1] == runs[2]


def test_few_dimensions_and_constant_vectors(spark):
    got = whitening.whiten(table(spark, [(i, [float(i % 5), 2.0]) for i in range(20)])).collect()
    assert {r["component"] for r in got} == {1} and {r["n"] for r in got} == {5} and got[0]["explained"] == pytest.approx(1)
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, []), (3, [None])])).count() == 0


def test_deviation_beyond_a_long_is_null():
    model = whitening.Whitening(3, (1 << 35, 0), 1.0, np.ones(1), np.ones((1, 2)))
    assert model.deviations(np.array([[1 << 35, 0], [(1 << 35) // 3, 1]])) == [None, (3 * ((1 << 35) // 3) - (1 << 35)) ** 2 + 9]


def test_exact_products(monkeypatch):
    rng = np.random.default_rng(0)
    for reach in (3, 1 << 20, 1 << 27):
        x = rng.integers(-reach, reach, (300, 4))
        wide = x.astype(object)
        assert whitening.exact_products(x) == (wide.T @ wide).reshape(-1).tolist()

"""Rank-one updates, merged spectra and whitening, against numpy on whole matrices."""

import numpy as np
import pytest

from quaystone.llm import whiten


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_rank_one_updates(size):
    rng = np.random.default_rng(size)
    values, vectors, full = np.zeros(size), np.eye(size), np.zeros((size, size))
    for i in range(4 * size + 5):
        v = rng.normal(size=size) * 10.0 ** rng.integers(-3, 4)
        if i % 5 == 1:
            v[rng.integers(size)] = 0
        if i % 7 == 2:
            v = vectors[:, rng.integers(size)] * 3.0  # along an eigenvector: all others are deflated
        if i % 11 == 3:
            v = np.zeros(size)
        rho = float(rng.random() + 0.1)
        values, vectors = whiten.rank_one(values, vectors, v, rho)
        full += rho * np.outer(v, v)
        assert np.all(np.diff(values) >= 0)
        assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-12
        assert np.abs(vectors * values @ vectors.T - full).max() <= 1e-12 * max(1e-300, np.abs(full).max())


def test_equal_and_near_values_are_deflated():
    values = np.array([1.0, 1.0, 1.0 + 1e-15, 2.0, 2.0, 5.0])
    v = np.array([1.0, 2.0, 3.0, 1e-18, 1.0, 0.0])
    new, vectors = whiten.rank_one(values, np.eye(6), v, 0.5)
    full = np.diag(values) + 0.5 * np.outer(v, v)
    assert np.allclose(new, np.linalg.eigvalsh(full), rtol=1e-14)
    assert np.abs(vectors * new @ vectors.T - full).max() < 1e-14


def test_merged_spectra():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(90, 12)) @ rng.normal(size=(12, 12)) + 50
    parts = []
    for a, b in ((0, 3), (3, 40), (40, 40), (40, 90)):
        s = whiten.Spectrum.empty(12)
        for r in rows[a:b]:
            s.add(r)
        parts.append(s)
    first = parts[0]
    for s in parts[1:]:
        first.merge(s)
    scatter = (rows - rows.mean(axis=0)).T @ (rows - rows.mean(axis=0))
    assert first.n == 90 and np.allclose(first.mean, rows.mean(axis=0), rtol=1e-13)
    assert np.abs(first.vectors * first.values @ first.vectors.T - scatter).max() < 1e-9 * np.abs(scatter).max()
    weighted = whiten.Spectrum.empty(12)
    weighted.add(rows[0], 3)
    weighted.add(rows[1], 2)
    again = np.concatenate([rows[[0] * 3], rows[[1] * 2]])
    assert np.allclose(weighted.vectors * weighted.values @ weighted.vectors.T, (again - again.mean(axis=0)).T @ (again - again.mean(axis=0)), atol=1e-9)


SCHEMA = "vec_id long, embedding array<float>, id_ string, component int"


def check(spark, rows, most, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    model = whiten.fit(df, most)
    got = {}
    for r in whiten.whiten(df, model, most).collect():
        got.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    lengths = [len(v) for _, v, *_ in rows if v and None not in v and np.isfinite(v).all()]
    size = min(set(lengths), key=lambda x: (-lengths.count(x), x))
    use = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000) for i, v, *_ in rows if v and len(v) == size and None not in v and np.isfinite(v).all()]
    x = np.stack([v for _, v in use])
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s) / n
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    assert {(i, sum(int(a) ** 2 for a in n * v - s)) for i, v in use} == set(got)
    for (i, _), comps in got.items():
        assert sorted(comps) == list(range(1, min(most, size) + 1))
        for c, r in comps.items():
            assert r.n == n and r.identity_error <= 1e-10
            if values[c - 1] > 1e-9 * values[0]:
                assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
                assert r.whitened == pytest.approx(float(centred[[j for j, (k, _) in enumerate(use) if k == i][0]] @ model.basis[:, c - 1]) / values[c - 1] ** 0.5, abs=1e-8)
            else:
                assert r.whitened is None and r.explained < 1e-9
    residual = centred.T @ centred / n @ model.basis - model.basis * model.values
    assert np.abs(residual).max() < 1e-11 * max(values[0], 1e-300)
    return got


def test_whitening(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(a) for a in v.astype(np.float32)], "x", 1) for i, v in enumerate(rng.normal(size=(300, 10)) * np.arange(1, 11))]
    rows += [(1000 + i, rows[3][1], None, None) for i in range(150)]  # a third is one vector
    rows += [(2000, None, "", 0), (2001, [], "", 0), (2002, [None] * 10, "", 0), (2003, [float("nan")] * 10, "", 0), (2004, [float("inf")] + [0.0] * 9, "", 0), (2005, [1.0, 2.0], "", 0), (None, [0.5] * 10, "", 0)]
    got = check(spark, rows, 6)
    assert sum(1 for i, _ in got if i is not None and 1000 <= i < 2000) == 150
    check(spark, rows, 32, 1)


def test_whitening_without_variance(spark):
    check(spark, [(i, [1.0, float(i % 7), 2.0 * (i % 7)], "", 0) for i in range(40)], 32)
    df = spark.createDataFrame([(1, [1.0, 2.0], "", 0), (2, [1.0, 2.0], "", 0)], SCHEMA)
    rows = whiten.whiten(df, whiten.fit(df)).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows] == [(c, 0, None, 0.0, 0.0) for _ in (1, 2) for c in (1, 2)]
    none = df.where("vec_id > 5")
    assert whiten.fit(none) is None and whiten.whiten(none, None).count() == 0


def test_deviation_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [0.0], "", 0), (2, [2.0**45], "", 0)], SCHEMA)
    assert {(r.vec_id, r.deviation) for r in whiten.whiten(df, whiten.fit(df, scale=1, shift=0)).collect()} == {(1, None), (2, None)}
    with pytest.raises(OverflowError):
        list(whiten.whole_numbers(__import__("pyarrow").array([[1e30]]), 64, 0))

"""Lattice hashing against brute force, whitening against an eigendecomposition of the covariance."""

import math

import numpy as np
import pytest

from vacantia.llm import lattice, whitening

SCHEMA = "vec_id long, embedding array<double>, n_links string, component string, node long, cell string"


def rows(vectors, first=1):
    return [(first + i, [float(x) for x in v], "a", "b", 1, None) for i, v in enumerate(vectors)]


def at_cosine(rng, base, cosine):
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return cosine * base + math.sqrt(1 - cosine * cosine) * other


def brute(ids, vectors, cosine=0.9):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    least = ids.copy()
    while True:
        now = np.minimum(least, np.where(near, least[None, :], ids.max() + 1).min(axis=1))
        if (now == least).all():
            return {int(i): (int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1), least)}
        least = now


def linked(frame, **options):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(frame, **options).collect()}


@pytest.mark.parametrize("block_rows", [lattice.BLOCK_ROWS, 16])
def test_links_of_planted_pairs_and_a_large_family(frame, block_rows):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    family = np.repeat(base[:1], 120, axis=0) + rng.normal(scale=0.06, size=(120, 24))
    vectors = np.concatenate([base, at_cosine(rng, base, 0.902), at_cosine(rng, base, 0.898) * 7, at_cosine(rng, base, 0.96), family, base[:40]])
    got = linked(frame(rows(vectors), SCHEMA), block_rows=block_rows)
    expected = brute(np.arange(1, len(vectors) + 1), vectors)
    assert got == expected
    assert sum(n for n, _, _ in expected.values()) > 5000


def test_links_of_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found = table.collect()
    assert linked(table) == brute(np.array([r["vec_id"] for r in found]), np.array([r["embedding"] for r in found], float))


def test_links_of_odd_vectors(frame):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1e200, 2e200]),
           (9, [1e-200, 2e-200]), (10, [1.0, 2.0, 0.0]), (10, [1.0, 2.0, 0.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0])]
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in lattice.near_vectors(
        frame([(i, v, None, None, None, None) for i, v in odd], SCHEMA)).collect())
    assert got == sorted([(str(i), 0, str(i), True) for i in (1, 2, 3, 4, 5, 6, None)] + [("7", 2, "7", True), ("8", 2, "7", False), ("9", 2, "7", False)]
                         + [("10", 1, "10", True)] * 2 + [("11", 1, "11", True), ("12", 1, "11", False)])  # [1, 2] and [0, 1]: 0.894
    assert lattice.near_vectors(frame([], SCHEMA)).collect() == []


def test_nearest_point_of_the_lattice():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 8)) * 2
    point = lattice.nearest_point(x)
    assert ((2 * point) % 1 == 0).all() and (point.sum(axis=1) % 2 == 0).all()
    assert (((x - point) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - point[:, None] - lattice.SHORTEST) ** 2).sum(axis=2) + 1e-9).all()
    assert len(lattice.SHORTEST) == 240 and np.allclose((lattice.SHORTEST ** 2).sum(axis=1), 2)


def test_pairs_at_the_threshold_meet_and_distant_ones_do_not():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    own = lattice.Lattice().cells(lattice.unit_vectors(base))
    for cosine, low, high in ((0.9, 0.35, 0.45), (0.0, 0, 0.001)):
        other = lattice.Lattice().cells(lattice.unit_vectors(at_cosine(rng, base, cosine)))
        cells, at = np.concatenate([own, other]), np.arange(2000)
        meets = np.stack([lattice._meets(cells, at, at + 2000, t) for t in range(lattice.TABLES)])
        assert low <= meets.mean() <= high
        assert cosine == 0 or meets.any(axis=0).all()
    assert (lattice.Lattice().cells(lattice.unit_vectors(base[7:9])) == own[7:9]).all()


def whitened(frame, **options):
    return whitening.whiten(frame, **options).collect()


@pytest.mark.parametrize("components", [8, 3])
def test_whitening_of_given_embeddings(spark, components):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(150)
    data = {r["vec_id"]: r["embedding"] for r in table.collect()}
    ids = sorted(data)
    x = np.floor(1024 * np.array([data[i] for i in ids], float)).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    expected = centred @ turn[:, :components] / np.sqrt(values[:components])
    got = {(r["vec_id"], r["component"]): r for r in whitened(table, components=components)}
    assert len(got) == n * components
    z = np.array([[got[i, c + 1]["whitened"] for c in range(components)] for i in ids])
    assert np.abs(z * np.sign((z * expected).sum(axis=0)) - expected).max() < 1e-10
    assert [got[i, 1]["deviation"] for i in ids] == [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    assert {r["n"] for r in got.values()} == {n} and max(r["identity_error"] for r in got.values()) < 1e-10
    assert np.allclose([got[ids[0], c + 1]["explained"] for c in range(components)], values[:components] / values.sum(), rtol=1e-12)


def test_bidiagonal_matrix_and_equal_deviations():
    rng = np.random.default_rng(6)
    left, _ = np.linalg.qr(rng.normal(size=(40, 6)))
    right, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    x = left * [5, 5, 5, 2, 2, 0] @ right.T
    v, b = whitening.bidiagonalised(lambda w: x.T @ (x @ w), 6)
    assert np.allclose(v.T @ v, np.eye(6)) and np.allclose(np.triu(np.tril(b, 1)), b)
    assert np.allclose(np.linalg.svd(b)[1], [5, 5, 5, 2, 2, 0], atol=1e-6)
    assert np.allclose(v @ b.T @ b @ v.T, x.T @ x, atol=1e-9)


def test_whitening_of_odd_tables(frame):
    nan, inf = float("nan"), float("inf")
    assert whitened(frame([], SCHEMA)) == []
    assert whitened(frame(rows([[1.0, 2.0]] * 3), SCHEMA)) == []
    odd = [(1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (None, [1.0, 0.0]), (6, [0.0, 1.0]), (6, [0.0, 1.0]), (7, [-3.0, 0.5])]
    got = whitened(frame([(i, v, None, None, None, None) for i, v in odd], SCHEMA))
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in got) == sorted((str(i), c, 4) for i in (None, 6, 6, 7) for c in (1, 2))
    with pytest.raises(Exception, match="different lengths"):
        whitened(frame(rows([[1.0], [1.0, 2.0]]), SCHEMA))


def test_exact_deviations_beyond_64_bit_products():
    white = whitening.Whitening(1 << 40, [5 << 40, 7 << 40], np.zeros((2, 0)), np.zeros(0), 1.0)
    assert white.deviations(np.array([[5, 7]])).tolist() == [0]
    with pytest.raises(OverflowError):
        white.deviations(np.array([[5, 8]]))

"""Rows against all rows in passing blocks: from files and broadcast, against plain numpy."""

import numpy as np
import pytest
from vecloom.operators import blocks, diffusion, graphs, metrics, neighbors, retrieval, subspace

WAYS = ({"broadcast_numbers": 0, "block": 7}, {})


@pytest.fixture(scope="module")
def some():
    x = np.random.default_rng(8).normal(size=(60, 6))
    x[40:50] = x[3]  # ties
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_row(w):
    np.fill_diagonal(w, 0.0)
    total = w.sum(axis=1)
    np.fill_diagonal(w, -np.inf)
    return [(i, len(w) - 1, pytest.approx(total[i]), pytest.approx(w[i].max())) for i in range(len(w))]


def _got(rows):
    return sorted((r.i, r.n, r.degree, r.top) for r in rows.collect())


def test_places_that_are_the_same():
    a, b = np.array([5, 1, 7, 5]), np.array([5, 2, 5, 1])
    assert sorted(zip(*map(np.ndarray.tolist, blocks.same(a, b)))) == [(0, 0), (0, 2), (1, 3), (3, 0), (3, 2)]


@pytest.mark.parametrize("way", WAYS)
def test_nearest_with_ties_over_blocks(spark, table, some, way):
    s = np.round(some @ some.T, 10)
    np.fill_diagonal(s, -np.inf)
    want = [(i, int(j), n + 1) for i in range(60) for n, j in enumerate(np.argsort(-s[i], kind="stable")[:12])]
    rows = table(some)
    assert sorted((r.i, r.j, r["rank"]) for r in neighbors.top_k(rows, rows, 12, skip_self=True, **way).collect()) == sorted(want, key=lambda t: (t[0], t[1]))


@pytest.mark.parametrize("way", WAYS)
def test_scores_that_single_precision_cannot_tell_apart(spark, table, way):
    """Scores 1e-9 apart keep their order, and equal ones go by id, whichever block they come in."""
    x = np.array([[1.0, 1e-9 * (i % 5)] for i in range(40)])
    want = sorted(range(40), key=lambda i: (-(i % 5), i))[:9]
    got = neighbors.top_k(table([[1.0, 1.0]]), table(x), 9, **way)
    assert [r.j for r in sorted(got.collect(), key=lambda r: r["rank"])] == want


def test_a_large_index_is_written_once_and_not_shuffled_by_blocks(spark, table, some):
    rows = table(some)
    plan = neighbors.top_k(rows, rows, 3, block=5, broadcast_numbers=0)._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Generate" not in plan


@pytest.mark.parametrize("way", WAYS)
def test_dense_graph_by_its_rows(spark, table, some, way):
    s = np.round(some @ some.T, 10)
    rows = table(some)
    assert _got(graphs.dense_rows(rows, **way)) == _by_row(s.copy())
    assert _got(graphs.dense_rows(rows, graphs.absolute, **way)) == _by_row(np.abs(s))
    assert _got(graphs.dense_rows(rows, graphs.rbf(0.5), **way)) == _by_row(np.exp((2 * np.clip(s, -1, 1) - 2) / 0.5))
    assert graphs.dense_rows(rows.limit(1), **way).count() == graphs.dense_rows(rows.limit(0), **way).count() == 0


@pytest.mark.parametrize("way", WAYS)
def test_scaled_membership_by_its_rows(spark, table, some, way):
    c, n = np.abs(np.round(some @ some.T, 10)), len(some)
    u, v = np.zeros(n), np.zeros(n)
    for t in range(4):
        m = (c + u[:, None] + v[None]) / 0.1
        step = 0.1 * (-np.log(n) - np.log(np.exp(m).sum(axis=1 - t % 2)))
        u, v = (u + step, v) if t % 2 == 0 else (u, v + step)
    p = n * np.exp((c + u[:, None] + v[None]) / 0.1)
    want = [(i, n, pytest.approx(p[i].sum()), pytest.approx(p[i].max())) for i in range(n)]
    assert _got(graphs.sinkhorn_rows(table(some), 0.1, 4, **way)) == want
    assert {(r.i, r.j): r.p for r in graphs.sinkhorn(table(some), 0.1, 4).collect()} == {(i, j): pytest.approx(p[i, j]) for i in range(n) for j in range(n)}


@pytest.mark.parametrize("way", WAYS)
def test_kernel_by_its_rows_and_its_heaviest_edges(spark, table, some, way):
    names = np.random.default_rng(9).normal(size=(25, 6))
    p = np.exp(np.round(some @ names.T, 10) / 0.3)
    p /= p.sum(axis=1, keepdims=True)
    w = np.round(some @ some.T, 10) * np.round(p @ p.T, 10) / 0.09
    rows, nouns = table(some), table(names)
    assert _got(diffusion.kernel_rows(rows, nouns, 0.3, **way)) == _by_row(w.copy())
    np.fill_diagonal(w, -np.inf)
    got = diffusion.kernel_nearest(rows, nouns, 0.3, 4, **way).toPandas()
    for i, part in got.groupby("i"):
        assert sorted(part["w"], reverse=True) == pytest.approx(np.sort(w[i])[::-1][:4]) and len(set(part["j"])) == 4 and i not in set(part["j"])


def test_soft_retrieval_from_files(spark, table, some):
    rows, nouns = table(some[:20]), table(some[20:])
    e = np.exp(some[:20] @ some[20:].T / 0.05) @ some[20:]
    want = e / np.linalg.norm(e, axis=1, keepdims=True)
    for numbers in (0, 10**6):
        got = sorted(retrieval.soft_retrieval(rows, nouns, 0.05, numbers).collect())
        assert np.allclose([r.x for r in got], want)


@pytest.mark.parametrize("way", WAYS)
def test_euclidean_sums_by_cluster(spark, some, way):
    rows = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(some)], "id long, x array<double>, pred int")
    d = np.linalg.norm(some[:, None] - some[None], axis=2)
    got = {(r.id, r.pred, r.other): (r.t, r.m) for r in metrics._euclidean_sums(rows, **way).collect()}
    assert got == {(i, i % 3, k): (pytest.approx(d[i, k::3].sum(), abs=1e-6), 20) for i in range(60) for k in range(3)}


@pytest.mark.parametrize("way", WAYS)
def test_pursuit_in_passing_blocks(spark, table, some, way):
    got = {}
    for r in subspace.omp(table(some), 3, **way).collect():
        got.setdefault(r.i, {})[r.j] = r.w
    for i, y in enumerate(some):
        rest, atoms = y, []
        for _ in range(3):
            s = np.round(np.abs(some @ rest), 12)
            s[i] = -1
            atoms.append(int(s.argmax()))
            w = np.linalg.pinv(some[atoms] @ some[atoms].T, hermitian=True) @ (some[atoms] @ y)
            rest = y - w @ some[atoms]
            if rest @ rest < 1e-6:
                break
        assert got[i] == {a: pytest.approx(c, abs=1e-8) for a, c in zip(atoms, w)}

"""Whitening against a dense eigensolver, near vectors against all pairs."""

import numpy as np
import pytest

from mdspark.functions.kernels import components
from mdspark.llm import vector_dedup as v
from mdspark.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, whitened string, node string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], "w", "n") for i, x in rows], SCHEMA).repartition(parts)


def dense(vectors):
    """(x, n, S, eigenvalues, eigenvectors, trace) of whole vectors by numpy alone."""
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return x, n, s, e[::-1], u[:, ::-1], np.trace(c.T @ c / n)


@pytest.mark.parametrize("dim,want,spread", [(40, 5, 1.1), (40, 5, 3.0), (3, 16, 2.0), (24, 4, 1.0)])
def test_same_as_dense(spark, dim, want, spread):
    r = np.random.default_rng(dim)
    a = r.standard_normal((500, dim)) * spread ** -np.arange(dim) * 3
    rows = [*enumerate(a), (900, a[0]), (900, a[1]), (None, a[2]), (901, None), (902, [None] + [1.0] * (dim - 1)), (903, [float("nan")] * dim), (904, [float("inf")] * dim), (905, [])]
    got = w.whiten(table(spark, rows), want).toPandas()
    x, n, s, e, u, trace = dense(a)
    k = min(want, dim)
    assert len(got) == 503 * k and (got.n == n).all()
    own = got[got.vec_id < 500].sort_values(["vec_id", "component"])
    z = own.whitened.to_numpy().reshape(-1, k)
    want_z = ((x * n - s) / n) @ u[:, :k] / np.sqrt(e[:k])
    assert np.abs(z * np.sign((z * want_z).sum(0)) - want_z).max() < 1e-8
    assert np.abs(own.explained.to_numpy()[:k] - e[:k] / trace).max() < 1e-12
    assert own.deviation.tolist()[::k] == ((x * n - s) ** 2).sum(1).tolist()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_few_passes_and_wider_blocks(monkeypatch):
    """The filter certifies what a dense solver finds; a block that gets nowhere is doubled until it does."""
    r = np.random.default_rng(1)
    q = np.linalg.qr(r.standard_normal((120, 120)))[0]
    e = np.concatenate([[500, 40, 39, 38], np.linspace(30, 1, 116)])
    passes = []

    def product(y):
        passes.append(y.shape[1])
        return (q * e) @ (q.T @ y)

    got, u = w.leading(product, 120, 4)
    assert np.abs(got - e[:4]).max() < 1e-9 and np.abs(np.abs(u.T @ q[:, :4]) - np.eye(4)).max() < 1e-9
    assert len(passes) < 120
    monkeypatch.setattr(w, "PATIENCE", 1)
    got, _ = w.leading(product, 120, 4)
    assert np.abs(got - e[:4]).max() < 1e-9


def test_whitening_edges(spark):
    assert w.whiten(table(spark, [])).count() == 0
    assert w.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one distinct vector, no variance
    line = w.whiten(table(spark, [(i, [i, 2.0 * i, 5.0]) for i in range(9)])).toPandas()
    assert line.component.unique().tolist() == [1] and len(line) == 9  # rank one
    both = w.whiten(table(spark, [(i, [i % 3, i]) for i in range(9)] + [(20 + i, [i * i]) for i in range(4)])).toPandas()
    assert sorted(both.groupby("vec_id").size().unique()) == [1, 2]  # each length by itself
    huge = w.whiten(table(spark, [(i, [1e300 * (i % 2), i]) for i in range(6)])).toPandas()
    assert len(huge) and np.isfinite(huge.whitened).all()


def links(rows, threshold=0.9):
    """(vec_id, n_links, component) of all pairs."""
    good = [(i, np.asarray(x, float)) for i, x in rows if i is not None and x is not None and len(x) and None not in list(x) and np.isfinite(np.asarray(x, float)).all() and np.any(x)]
    ids = np.array([i for i, _ in good])
    order = np.argsort(ids, kind="stable")
    good, ids = [good[i] for i in order], ids[order]
    a, b = [], []
    for i in range(len(good)):
        for j in range(i):
            x, y = good[i][1], good[j][1]
            if len(x) == len(y) and (v.unit(x[None]) * v.unit(y[None])).sum() >= threshold:
                a.append(i)
                b.append(j)
    label = components(len(good), np.array(a, int), np.array(b, int))
    n = np.bincount(a + b, minlength=len(good))
    return sorted((int(i), int(k), int(ids[c]), bool(i == ids[c])) for i, k, c in zip(ids, n, label))


def turned(r, x, cosine):
    z = r.standard_normal(len(x))
    z -= z @ x * x / (x @ x)
    return cosine * x / np.linalg.norm(x) + (1 - cosine**2) ** 0.5 * z / np.linalg.norm(z)


@pytest.mark.parametrize("window,block", [(128, 512), (3, 2)])
def test_same_as_all_pairs(spark, monkeypatch, window, block):
    """Chains, a group wider than the half angle, a tight group, copies, scaled copies, other lengths and odd rows."""
    monkeypatch.setattr(v, "WINDOW", window)
    monkeypatch.setattr(v, "BLOCK", block)
    r = np.random.default_rng(4)
    base = [r.standard_normal(24) for _ in range(60)]
    rows = list(base)
    rows += [turned(r, base[0], 0.96) for _ in range(25)]  # wide: some pairs of these are not linked
    rows += [turned(r, base[1], 0.999) for _ in range(40)]
    rows += [base[2]] * 30 + [7.5 * base[2], 1e-30 * base[2], 1e30 * base[2]]
    chain = base[3]
    for _ in range(6):
        chain = turned(r, chain, 0.97)
        rows.append(chain)
    rows += [np.array([1.0, 0.0]), np.array([1.0, 0.1]), np.array([0.0, 1.0])]
    rows = [(3 * i, x) for i, x in enumerate(rows)] + [(1, base[4]), (1, base[5]), (2, None), (5, [0.0] * 24), (8, [float("nan")] * 24), (11, [None] * 24), (14, []), (None, base[6])]
    got = v.near_vectors(table(spark, rows)).collect()
    assert len(got) == len(rows)
    alone = {2, 5, 8, 11, 14}
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None and r.vec_id not in alone) == links(rows)
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id is None or r.vec_id in alone)


def test_pairs_at_the_threshold_are_found(spark):
    r = np.random.default_rng(8)
    base = [r.standard_normal(64) for _ in range(2000)]
    rows = list(enumerate(base)) + [(5000 + i, turned(r, base[i], 0.9001)) for i in range(300)]
    got = v.near_vectors(table(spark, rows, 4)).toPandas()
    assert got[got.vec_id >= 5000].n_links.clip(upper=1).mean() >= 0.9


def test_no_vectors(spark):
    assert v.near_vectors(table(spark, [])).count() == 0

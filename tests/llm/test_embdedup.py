import numpy as np
import pytest

from tessera.llm import embdedup as D


def brute(vectors, t=0.9):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    link = u @ u.T >= t
    np.fill_diagonal(link, False)
    comp = np.arange(len(u))
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], len(u)).min(axis=1))
        if (new == comp).all():
            return link.sum(axis=1), comp
        comp = new


def groups(rng, dims=64):
    """Single vectors, copies, tight and loose groups, and chains around the threshold."""
    out = [rng.standard_normal(dims) for _ in range(300)]
    for size, noise in ((60, 0.0), (80, 0.02), (40, 0.05), (30, 0.09), (5, 0.0)):
        c = rng.standard_normal(dims)
        out += [c + noise * np.linalg.norm(c) / 8 * 8 * rng.standard_normal(dims) / np.sqrt(dims) * 4 for _ in range(size)]
    a, b = rng.standard_normal((2, dims))
    b -= a * (a @ b) / (a @ a)
    b *= np.linalg.norm(a) / np.linalg.norm(b)
    out += [np.cos(x) * a + np.sin(x) * b for x in np.arange(0, 2.0, 0.2)]
    order = rng.permutation(len(out))
    return np.array(out)[order]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_brute_force(spark, seed):
    v = groups(np.random.default_rng(seed)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    got = {r.vec_id: r for r in D.query(df).collect()}
    n, comp = brute(v.astype(np.float64))
    found = np.array([got[i].n_links for i in range(len(v))])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    assert np.mean([got[i].component_id == comp[i] for i in range(len(v))]) > 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_edges(spark):
    a, inf, nan = [1.0, 0.0, 0.0], float("inf"), float("nan")
    rows = [(1, a), (2, a), (2, a), (3, None), (4, []), (5, [0.0] * 3), (6, [1.0, None, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 0.0, 0.0]), (None, a), (9, [1.0, 0.0]), (10, [2.0, 0.0, 0.0]), (11, [-1.0, 0.0, 0.0]), (None, None)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, id string, v string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in D.query(df).collect()), key=lambda r: (r[0] is None, r[0]))
    want = [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)] + [(i, 0, i, True) for i in range(3, 10)] + [(10, 2, 1, False), (11, 0, 11, True)] + [(None, 0, None, False)] * 2
    assert got == want
    assert D.query(df.limit(0)).count() == 0


def test_parameters_follow_the_number_of_vectors():
    """Chance meetings per vector stay bounded and pairs at the threshold keep their chance, while tables grow slowly."""
    near, far = D.collision(np.sqrt(0.2)), D.collision(np.sqrt(2))
    before = 0
    for n in (1, 100, 10_000, 1_000_000, 10**9, 10**12):
        tables, k = D.parameters(n)
        assert n * tables * far**k <= D.CHANCE and 1 - (1 - near**k) ** tables >= D.RECALL and tables >= before
        assert tables <= 40 * max(n, 10) ** 0.3
        before = tables
    rng = np.random.default_rng(0)
    for distance, p in ((np.sqrt(0.2), near), (np.sqrt(2), far)):
        x, shift = rng.standard_normal(200_000) * distance, rng.uniform(0, 1, 200_000)
        assert abs(np.mean(np.floor(x / D.WIDTH + shift) == np.floor(shift)) - p) < 0.01


def test_copies_are_counted(spark):
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 16))
    rows = [a] * 200 + [a + 0.01 * b] * 100 + [b] * 3
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in D.query(df).collect()}
    assert all(got[i] == (299, 0) for i in range(300)) and all(got[i] == (2, 300) for i in range(300, 303))

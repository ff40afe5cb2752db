import itertools

import numpy as np

from redline.llm import lattice

ROW = "vec_id long, embedding array<float>, label int"


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    got = lattice.e8(x)
    doubled = got * 2
    assert (doubled == np.rint(doubled)).all()
    assert ((doubled % 2 == 0).all(1) | (doubled % 2 == 1).all(1)).all() and (got.sum(1) % 2 == 0).all()
    around = got[:, None, :] + lattice.minimal()[None]
    assert (((x[:, None, :] - around) ** 2).sum(-1).min(1) >= ((x - got) ** 2).sum(-1) - 1e-9).all()
    assert len(lattice.minimal()) == 240


def truth(rows, cosine=0.95):
    ids = [r[0] for r in rows]
    x = [np.array(r[1], float) if r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) else None for r in rows]
    links, root = {k: 0 for k in range(len(rows))}, list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k
    for a, b in itertools.combinations(range(len(rows)), 2):
        if x[a] is not None and x[b] is not None and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= cosine:
            links[a] += 1
            links[b] += 1
            root[top(a)] = top(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted((i or 0, links[k], least.get(top(k))) for k, i in enumerate(ids))


def got(spark, rows):
    return sorted((r.vec_id or 0, r.n_links, r.component_id) for r in lattice.query(spark.createDataFrame(rows, ROW)).collect())


def groups(rng, n=60, dim=64):
    """Groups at angles well inside the threshold, copies, and lone vectors."""
    out = []
    for k in range(n):
        x = rng.normal(size=dim)
        for _ in range(k % 4):
            out.append((x + rng.normal(size=dim) * 0.12).astype(np.float32).tolist())
        out.append(x.astype(np.float32).tolist())
        if k % 7 == 0:
            out += [out[-1]] * 3
    return [(k, v, 0) for k, v in enumerate(out)]


def test_equals_brute_force(spark):
    rows = groups(np.random.default_rng(5))
    assert got(spark, rows) == truth(rows)


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is just above 0.95: at least nine of ten are linked."""
    rng, rows = np.random.default_rng(6), []
    for k in range(400):
        x, y = rng.normal(size=(2, 64))
        y -= x * (x @ y) / (x @ x)
        x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
        rows += [(2 * k, x.tolist(), 0), (2 * k + 1, (0.951 * x + np.sqrt(1 - 0.951 ** 2) * y).tolist(), 0)]
    assert sum(r[1] for r in got(spark, rows)) >= 0.95 * sum(t[1] for t in truth(rows)) > 0


def test_recall_in_a_crowded_table():
    """Of 3,000 pairs at 0.95 among 100,000 vectors at least 0.98 meet, as many as without the
    others; and few meet that aren't pairs."""
    rng, n = np.random.default_rng(9), 3000
    x, y = rng.normal(size=(2, n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= x * (x * y).sum(1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95 ** 2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    z = rng.normal(size=(100_000 - 2 * n, 64))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    found, met = np.zeros(n, bool), 0
    all_of = np.concatenate([x, y, z])
    draws, again = (np.random.default_rng([lattice.SEED, 64]) for _ in range(2))
    for t in range(lattice.TABLES):
        key, home = lattice.keys(all_of, t, lattice.NEIGHBOURS, draws), lattice.keys(all_of, t, 0, again)
        assert (key[:, :1] == home).all() and key.shape[1] == 1 + 2 * lattice.NEIGHBOURS
        found |= (key[:n] == home[n:2 * n]).any(1) | (key[n:2 * n] == home[:n]).any(1)
        cell, size = np.unique(home, return_counts=True)
        at = np.minimum(np.searchsorted(cell, key.ravel()), len(cell) - 1)
        met += int((size[at] * (cell[at] == key.ravel())).sum()) - len(home)
    assert found.mean() >= 0.98
    assert met <= 20 * len(all_of)  # one form of eight dimensions gave over 250 a vector


def test_meetings_of_random_vectors_are_few(spark):
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.random.default_rng(3).normal(size=(3000, 64)))]
    out = got(spark, rows)
    assert out == truth(rows)


def test_awkward(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0),
            (7, one, None), (7, one, 1), (8, [2.0, 4.0, 6.0], 0), (9, [1.0, 2.0], 0), (None, one, 0), (None, None, None),
            (10, [1e30, 2e30, 3e30], 0), (11, [1e-30, 2e-30, 3e-30], 0), (12, [-1.0, -2.0, -3.0], 0), (13, [0.0, 1.0], 0), (14, [-0.0, 1.0], 0)]
    out = lattice.query(spark.createDataFrame(rows, ROW)).collect()
    assert len(out) == len(rows)
    by = {r.vec_id: r for r in out if r.vec_id is not None}
    for k in (1, 2, 3, 4, 5, 6, 9, 12):
        assert (by[k].n_links, by[k].component_id, by[k].kept) == (0, k, True)
    assert {(r.n_links, r.component_id) for r in out if r.vec_id in (7, 8, 10, 11)} == {(5, 7)}
    assert by[13].n_links == by[14].n_links == 1 and by[14].component_id == 13
    assert lattice.query(spark.createDataFrame([], ROW)).collect() == []

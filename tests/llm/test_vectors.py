import random

import numpy as np

from inkwell.llm import vector_forest


def brute(rows, least=0.93):
    """Links and components of (id, vector, label) by comparing all pairs."""
    usable = []
    for i, v, label in rows:
        ok = v is not None and label is not None and i is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        usable.append(np.array(v, np.float32).astype(float) if ok else None)
    links, root = [0] * len(rows), {k: k for k in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = usable[a], usable[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y):
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    smallest = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            smallest[find(k)] = min(smallest.get(find(k), r[0]), r[0])
    return sorted(((r[0], n, smallest.get(find(k)) if r[0] is not None else None) for k, (r, n) in enumerate(zip(rows, links))), key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vector_forest.near_vectors(df, **more).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr)


def test_clusters_copies_and_odd_vectors(spark):
    rnd = np.random.default_rng(9)
    rows, centres = [], rnd.standard_normal((25, 16))
    for i in range(500):
        v = centres[rnd.integers(25)] + rnd.standard_normal(16) * 0.12
        rows.append((i, v.astype(np.float32).tolist(), int(rnd.integers(2))))
    rows += [(600 + i, rows[0][1], rows[0][2]) for i in range(30)]
    rows += [
        (700, None, 1), (701, [0.0] * 16, 1), (702, [float("nan")] * 16, 1), (703, [float("inf")] + [1.0] * 15, 1), (704, [None] + [1.0] * 15, 1),
        (705, [1.0] * 16, None), (706, [1.0] * 3, 1), (707, [2.0] * 3, 1), (708, [], 1), (None, [1.0] * 16, 1), (709, [1e-3] * 16, 1), (709, [1.0] * 16, 1),
    ]
    random.Random(1).shuffle(rows)
    got, want = found(spark, rows, leaf=64), brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    linked = sum(w[1] for w in want)
    missed = sum(abs(g[1] - w[1]) for g, w in zip(got, want))
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and missed <= 0.02 * linked


def test_leaf_that_cannot_be_split(spark):
    """Multiples of one vector project alike; they are compared in blocks."""
    rows = [(i, [float(i + 1) * x for x in (1.0, 2.0, -1.0)], 1) for i in range(200)]
    assert sorted(found(spark, rows, leaf=16)) == [(i, 199, 0) for i in range(200)]
    assert found(spark, [(1, [1.0], 1)][:0]) == []


def test_large_groups_of_near_copies(spark):
    """A cluster of jittered copies is far larger than a leaf, among vectors that are not near."""
    rnd = np.random.default_rng(4)
    base = rnd.standard_normal(64)
    for size, others in ((3000, 0), (3000, 6000)):
        near = base + rnd.standard_normal((size, 64)) * 0.2
        every = np.concatenate([near, rnd.standard_normal((others, 64))]).astype(np.float32)
        unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1)[:, None]
        want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
        assert want[:size].mean() > 0.9 * size
        got = {i: n for i, n, _ in found(spark, [(i, v.tolist(), 1) for i, v in enumerate(every)])}
        reached = np.array([got[i] for i in range(len(every))])
        assert (reached <= want).all() and reached.sum() >= 0.98 * want.sum()


def test_links_of_a_tile_are_spanned():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        links = rnd.random((12, 9)) < rnd.choice([0.05, 0.1, 0.3])
        a, b = vector_forest._spanning(links)
        assert links[a, b].all()

        def parts(pairs):
            label = list(range(21))
            for x, y in pairs:
                old, new = label[x], label[12 + y]
                label = [new if v == old else v for v in label]
            return {frozenset(k for k in range(21) if label[k] == v) for v in label}

        assert parts(zip(a, b)) == parts(np.argwhere(links).tolist())
        assert len(a) == 21 - len(parts(zip(a, b)))

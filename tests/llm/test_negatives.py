"""Hard negatives against all pairs in plain Python; score limits against true scores."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import negatives as hn


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    length = max((len(v) for _, v, _ in rows if v is not None), default=1) or 1
    limit = min(math.isqrt(2**62 // length), 2**31 - 1) - 1
    own = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not abs(256 * float(np.float32(x))) < limit for x in v):
            continue
        codes = [math.floor(256 * float(np.float32(x))) for x in v]
        own[i] = min(own.get(i, (label, codes)), (label, codes))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, (label, codes) in own.items():
        if not is_anchor(i):
            continue
        others = sorted((-score(codes, c), j, other) for j, (other, c) in own.items() if j != i)
        for s, j, _ in [o for o in others if o[2] == label][:positives]:
            fits = [(k, t) for t, k, other in others if other != label and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, rank, k, -s, -t) for rank, (k, t) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(spark, rows, every=10, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, part int, body string")
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % every == 0, **more).collect())


def clustered(n, seed=3, dim=12):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((9, dim))
    return [(i, (centres[rnd.integers(9)] + rnd.standard_normal(dim) * 0.4).astype(np.float32).tolist(), int(rnd.integers(4))) for i in range(n)]


def test_clusters_ties_and_odd_vectors(spark, monkeypatch):
    rows = clustered(900)
    rows += [(2000 + i, rows[10][1], i % 3) for i in range(60)]  # copies: ties by id
    big = [3.0e38] * 12
    rows += [
        (3000, None, 1), (3001, [], 1), (3010, [0.0] * 12, 1), (3020, [None] + [1.0] * 11, 1), (3030, [float("nan")] * 12, 1),
        (3040, [float("inf")] * 12, 1), (3050, [1.0] * 12, None), (None, [1.0] * 12, 1), (3060, [0.5] * 3, 1), (3070, big, 1),
        (3080, [1.0] * 12, 2), (3080, [0.5] * 12, 2), (3080, [1.0] * 12, 2), (3090, [-1.0] * 12, 3), (3091, [100.0] * 12, 9), (-10, [0.1] * 12, 0),
    ]
    random.Random(2).shuffle(rows)
    for name, value in {"BLOCK": 32, "GROUP": 300, "ANCHOR_BLOCK": 7, "CHUNK": 40, "SAMPLE": 50}.items():
        monkeypatch.setattr(hn, name, value)
    want = brute(rows, lambda i: i % 10 == 0)
    assert want and found(spark, rows) == want


def test_other_sizes(spark):
    rows = clustered(300, seed=5)
    assert found(spark, rows, positives=2, negatives=3, low=-50, high=70) == brute(rows, lambda i: i % 10 == 0, 2, 3, -50, 70)


def test_few_rows_and_no_rows(spark):
    assert found(spark, [(0, [1.0, 0.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.5, 0.0], 2)]
    assert found(spark, rows) == brute(rows, lambda i: i % 10 == 0) != []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hn.hard_negatives(empty, F.lit(True)).count() == 0


def test_limits_hold_and_prune():
    rnd = np.random.default_rng(8)
    centres = rnd.standard_normal((6, 16))
    codes = np.floor((centres[rnd.integers(6, size=800)] + rnd.standard_normal((800, 16)) * 0.15) * 256).astype(np.int64)
    references = hn.fit_references(codes, 6)
    theta, norms = hn.angles(codes, references)
    scores = hn.exact_scores(codes[:100], codes)
    low, high = hn.score_limits(
        theta[:100, None], theta[:100, None], (norms[:100, None],) * 2, theta[None], theta[None], (norms[None],) * 2
    )
    assert (low <= scores).all() and (scores <= high).all()

    block = hn.Vectors(np.arange(800), np.zeros(800, int), codes, theta, norms)
    wanted = [[hn.Best(5, int(0.9 * n * n), hn.INT.max)] for n in norms[:20]]
    anchors = hn.Anchors(np.arange(20), np.zeros(20, int), codes[:20], theta[:20], norms[:20], wanted, True)
    assert 0 < anchors.meet(block) <= 20 * 800
    k = theta[:, [block.reference]].argmin(0)
    single = hn.Anchors(k, np.zeros(1, int), codes[k], theta[k], norms[k], [[hn.Best(5, int(0.9 * norms[k[0]] ** 2), hn.INT.max)]], True)
    assert 0 < single.meet(block) < 400  # the window of angles leaves most vectors out


def test_scores_beyond_doubles():
    a = np.array([[2**30, 3, -(2**30)]])
    assert hn.exact_scores(a, np.array([[2**30, 1, 2**30 - 1]]))[0, 0] == 2**60 + 3 - 2**30 * (2**30 - 1)

import bisect
import random
import re

import numpy as np
import pyarrow as pa

from inkwell.llm import ngram_join, shingles


def sets_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    """(id, set size, component) by comparing all pairs; rows of one id are one document."""
    sets = [(i, sets_of(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def joined(docs, **more):
    return sorted(map(tuple, ngram_join.similar_texts(docs, **more).collect()), key=repr)


def test_shingles_are_sets():
    texts = ["A b c d E f", "a B c d e f", "a b", "A  B\n", "", None, " ", "a b c d e a b c d e", "é É b c d", "a\x1cb c d e f"]
    got = shingles.shingle_sets(pa.array(texts))
    assert [len(s) for s in got] == [len(sets_of(t)) for t in texts]
    assert got[0].tolist() == got[1].tolist() and got[2].tolist() == got[3].tolist()
    assert all((np.diff(s.view(np.uint64).astype(object)) > 0).all() for s in got if len(s) > 1)


def test_signatures_bound_the_overlap():
    rnd = random.Random(4)
    for _ in range(200):
        pool = [rnd.getrandbits(64) for _ in range(rnd.randint(1, 300))]
        a, b = (np.unique(np.array(rnd.sample(pool, rnd.randint(1, len(pool))), np.uint64)) for _ in range(2))
        bound = ngram_join.overlap_bound(ngram_join.signature(a), len(a), ngram_join.signature(b), len(b))
        assert bound >= len(np.intersect1d(a, b))


def test_join_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTERS", 1 << 8)
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = rnd.choices(vocabulary, k=30)
    texts = []
    for _ in range(60):
        base = rnd.choices(vocabulary, k=rnd.randint(5, 120))
        if rnd.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        texts.append(base)
        for _ in range(rnd.choice([0, 0, 1, 8])):  # chains of edits, and copies
            copy = list(texts[-1] if rnd.random() < 0.5 else base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(d.doc_id, d.text) for d in odd_docs.collect()]
    assert joined(odd_docs) == brute(rows)
    assert joined(no_docs) == []
    kept = ngram_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = {c for _, _, c in brute(rows)}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(groups, key=repr)
    assert ngram_join.one_of_each(no_docs).count() == 0


def test_a_similar_larger_set_is_at_most_one_band_up():
    limits = ngram_join.band_limits()
    assert limits == sorted(limits) and limits[0] == 1 and limits[-1] >= 1 << 40
    for n in [*range(1, 3000), 10**6 - 1, 10**9, 3 * 10**11]:
        assert bisect.bisect_right(limits, n * 4 // 3) - bisect.bisect_right(limits, n) in (0, 1)

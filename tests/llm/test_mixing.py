import random
import re
from collections import defaultdict

from inkwell.llm import mixing


def wanted_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Give every source its share and hand on what is above a limit until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_equal_resharing(spark):
    rnd = random.Random(2)
    for _ in range(4):
        sizes = {s: rnd.choice([0, 1, 5, 40, 1000]) for s in ["a", "b", "é", "Z", "日", None]}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        want = wanted_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_flight_keeps_both_totals():
    for seed in range(30):
        rnd = random.Random(seed)
        p = rnd.random()
        units = [[float(rnd.randint(0, 500)), p] for _ in range(rnd.randint(3, 300))]
        size, n = sum(u[0] * u[1] for u in units), sum(u[1] for u in units)
        mixing.flight(units, rnd)
        assert sum(0 < u[1] < 1 for u in units) <= 2
        assert abs(sum(u[0] * u[1] for u in units) - size) < 1e-4 and abs(sum(u[1] for u in units) - n) < 1e-6


def test_mix_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randint(0, 60), rnd.choice("aaab") if i % 7 else None) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted(map(tuple, mixing.mix(docs).select("doc_id", "size", "target", "copies", "source").collect()), key=repr)
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(7)).select("doc_id", "size", "target", "copies", "source").collect()), key=repr)
    taken, target = defaultdict(int), {}
    for _, size, aim, copies, source in first:
        assert copies in (0, 1, 2)
        taken[source] += size * copies
        target[source] = aim
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)


def test_odd_documents(spark, odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    sizes = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"]) for r in got)
    assert sizes == sorted((-1 if d.doc_id is None else d.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))) for d in odd_docs.collect())
    copies = sum(r["copies"] for r in got)
    mixed = mixing.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == copies
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0

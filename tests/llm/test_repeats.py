import random
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import repeats


def brute(texts, length):
    windows = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if windows[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def longest_elsewhere(text):
    def common(i, j):
        k = 0
        while i + k < len(text) and j + k < len(text) and text[i + k] == text[j + k]:
            k += 1
        return k

    return [max([common(i, j) for j in range(len(text)) if j != i] or [0]) for i in range(len(text))]


def test_index_streams_matching_statistics():
    rnd = random.Random(6)
    for _ in range(150):
        alphabet = rnd.choice([b"ab", b"abc\x00\xff", b"abcdefgh"])
        text = bytes(rnd.choice(alphabet) for _ in range(rnd.randint(1, 50))) * rnd.randint(1, 3)
        array = np.frombuffer(text, np.uint8)
        assert repeats.suffix_order(array).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        index = repeats.RunLengthIndex(array)
        assert index.lengths.sum() == len(text) and len(index.lengths) <= len(text)
        assert index.matching_statistics().tolist() == longest_elsewhere(text)


def test_pieces_hold_every_window_once():
    rnd = random.Random(7)
    for _ in range(40):
        texts = [bytes(rnd.choice(b"abc ") for _ in range(rnd.randint(0, 200))) for _ in range(5)]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        text, start, n, core, piece = repeats.pieces(np.frombuffer(b"".join(texts), np.uint8), at, 40)
        got = sorted((a, b + i) for a, b, m in zip(text.tolist(), start.tolist(), n.tolist()) for i in range(m))
        assert got == [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 39)]


@pytest.mark.parametrize("many", [1000, 1])
def test_removal_equals_brute_force(spark, odd_docs, no_docs, monkeypatch, many):
    monkeypatch.setattr(repeats, "MANY", many)
    rnd = random.Random(8)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(40, 130))) for _ in range(6)]
    texts = [
        "".join(rnd.choice([rnd.choice(passages), "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 90)))]) for _ in range(rnd.randint(0, 6)))
        for _ in range(80)
    ] + ["ab" * 100, "a" * 300, "", None, "a" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: (*r[1:4], bytes(r[4])) for r in repeats.remove_repeats(docs, length=60).collect()}
    assert [got[i] for i in range(len(texts))] == brute([(t or "").encode() for t in texts], 60)
    rows = odd_docs.select("doc_id", "text").collect()
    odd = sorted((*r[1:4], bytes(r[4])) for r in repeats.remove_repeats(odd_docs).collect())
    assert odd == sorted(brute([(r.text or "").encode() for r in rows], 400))
    assert repeats.remove_repeats(no_docs).count() == 0

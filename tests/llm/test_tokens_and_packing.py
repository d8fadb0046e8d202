import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from inkwell.llm import packing, token_files
from inkwell.llm.common import scratch
from inkwell.llm.tokens import encoder


def ids_of(tokenizer, text):
    return encoder(tokenizer).tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_ids_of_the_library(tokenizer):
    rnd = random.Random(1)
    texts = ["", None, " ", "a  b\n\n c's don't ''s I'LL 12.5%  ", "<|endoftext|> x", "a\x1cb \x85 c", "q" * 4000]
    texts += ["".join(rnd.choice(" \n\t'sabLl1.,é 　日!ré̂\x0b") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    ids, at = encoder(tokenizer).encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(tokenizer, text)


def test_segment_gives_every_token():
    ids = np.array([0, 255, 256, 65535, 65536, 2**32 - 1] + [i * i for i in range(3000)], np.uint32)
    segment = token_files.Segment(token_files.encode_segment([4, None], np.array([6, 3000]), ids) + b"\n")
    assert [segment.token(i) for i in range(len(ids))] == ids.tolist() == segment.ids().tolist()
    assert segment.null_ids.tolist() == [0, 1] and segment.offsets.tolist() == [0, 6, 3006]


def test_token_files_round_trip(spark, odd_docs, no_docs, tokenizer):
    path = scratch(spark, "files")
    token_files.write_token_files(odd_docs, path, tokenizer)
    rows = token_files.documents_in(spark, path).orderBy("start").collect()
    docs = odd_docs.collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter(
        (d.doc_id, len(ids) + 1, crc(ids + [0])) for d in docs for ids in [ids_of(tokenizer, d.text)]
    )
    names = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert names == sorted(names)
    assert [r.start for r in rows] == (np.cumsum([0] + [r.n_tokens for r in rows])[:-1]).tolist()
    path = scratch(spark, "none")
    token_files.write_token_files(no_docs, path, tokenizer)
    assert token_files.documents_in(spark, path).count() == 0


def plain_best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [(b, i) for i, b in enumerate(bins) if b >= length]
        if fits:
            bins[min(fits)[1]] -= length
        else:
            bins.append(capacity - length)
    return bins


def test_plan_is_best_fit_decreasing():
    for seed in range(100):
        rnd = random.Random(seed)
        capacity = rnd.choice([7, 20, 64])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 80))]
        counts = Counter(lengths)
        steps = packing.best_fit_plan(dict(counts), capacity).tolist()
        filled = Counter()
        for length, n in counts.items():
            own = sorted((s for s in steps if s[0] == length), key=lambda s: s[1])
            for rank in range(n):
                step = [s for s in own if s[1] <= rank][-1]
                filled[step[3] + (rank - step[1]) // step[2]] += length
        assert sorted(capacity - f for f in filled.values()) == sorted(plain_best_fit(lengths, capacity))


def test_pack_documents(spark, odd_docs, no_docs, tokenizer):
    rows = packing.pack_documents(odd_docs, tokenizer, capacity=64, with_ids=True).collect()
    want = Counter()
    for d in odd_docs.collect():
        ids = ids_of(tokenizer, d.text) + [0]
        first = len(ids) % 64 or 64
        cuts = [0] + list(range(first, len(ids), 64)) + [len(ids)] if len(ids) > 64 else [0, len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(d.doc_id, i, a, b - a, crc(ids[a:b]), np.array(ids[a:b], "<u4").tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert len(sequences) == len(plain_best_fit([r.length for r in rows], 64))
    assert packing.pack_documents(no_docs, tokenizer).count() == 0

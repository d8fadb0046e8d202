"""Removal of long repeated passages with a run-length index (operator 8).

Every window of ``length`` bytes is anchored at the smallest hash of its 16-byte
strings, the leftmost of equals; equal windows have equal anchors at equal places.
Runs of windows with one anchor are pieces, cut where the anchor lies in the other
half of the window.  All windows of a piece share a core, the bytes that every one
of them holds; only pieces whose core occurs elsewhere can hold repeated windows.

1. A piece that occurs twice as a whole is repeated as a whole, found by counting.
2. Different pieces with one core meet in a small text.  Its Burrows-Wheeler
   transform is kept run by run, with the suffixes at the run ends as samples.
   Between samples the match with the neighbouring suffix only loses a byte a
   step, so the matching statistics of the text against itself are streamed from
   the samples; windows that they cover are repeated.
3. A core with very many different pieces (the edges of a passage that is
   everywhere) would make one large text.  Its windows are grouped by their hash
   instead, which no group size can break.

Texts are dealt to blocks and shuffled once; every pass reads that shuffle.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkwell.llm.blocks import Blocks, unpack
from inkwell.llm.common import stored, table
from inkwell.llm.shingles import mixed, steps_of
from inkwell.llm.tokens import string_buffers

LENGTH = 400
GRAM = 16
#: Bytes of pieces that are indexed together, and different pieces of a core beyond which windows are grouped.
INDEX_BYTES, MANY = 1 << 20, 1000
STEP_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        if n <= STEP_BYTES + 1:
            _powers[base] = held
    return held[:n]


class Substrings:
    """64-bit hashes of any substring of a byte array in constant time."""

    def __init__(self, raw: np.ndarray):
        terms = mixed(raw.astype(np.uint64) + np.uint64(0x51ED270B)) * _power(_BASE, len(raw))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _power(_INVERSE, len(self.sums))
        return mixed((self.sums[end] - self.sums[start]) * inverse[start])


def pieces(raw: np.ndarray, at: np.ndarray, length: int = LENGTH):
    """Arrays (text, start, n windows, core hash, piece hash) for texts raw[at[i] : at[i + 1]]."""
    n, wide = len(raw), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    padded = np.concatenate([raw, np.zeros(GRAM, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    low, high = words[:n].copy().view(np.uint64).ravel(), words[8 : n + 8].copy().view(np.uint64).ravel()
    grams = mixed(low * np.uint64(_BASE) + mixed(high))
    # the smallest of every `wide` values, from minima of blocks forwards and backwards
    values = np.full((-(-n // wide) + 1) * wide, ~np.uint64(0), np.uint64)
    values[:n] = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    blocks = values.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[: n - wide + 1], ahead[wide - 1 : n])
    last = np.repeat(at[1:], np.diff(at)) - length  # the last window of the text of every byte
    start = np.flatnonzero(np.arange(len(least)) <= last[: len(least)])
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    far = (anchor - start) >= wide // 2
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (far[1:] != far[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, anchor, far = start[first], anchor[first], far[first]
    # the core: from the anchor on for near anchors; from half a window before it for far ones
    reach = wide // 2
    core_from = np.where(far, anchor - reach, anchor)
    core_to = np.where(far, anchor + GRAM, anchor + length - reach + 1)
    hashes = Substrings(raw)
    core = mixed(hashes.of(core_from, core_to) + far.astype(np.uint64))
    # a piece is its bytes and the place of the anchor in them
    whole = mixed(hashes.of(begin, begin + count - 1 + length) + (anchor - begin).astype(np.uint64) * np.uint64(_BASE) + count.astype(np.uint64))
    text = np.searchsorted(at, begin, "right") - 1
    return text, begin - at[text], count, core, whole


class RunLengthIndex:
    """The run-length Burrows-Wheeler transform of a text, with the suffixes at both ends of every run."""

    def __init__(self, text: np.ndarray):
        self.text = text
        order = suffix_order(text)
        before = np.where(order > 0, text[order - 1].astype(np.int16), -1)
        edge = np.flatnonzero(before[1:] != before[:-1]) + 1
        starts = np.concatenate([[0], edge])
        ends = np.concatenate([edge, [len(text)]]) - 1
        self.symbols, self.lengths = before[starts], ends - starts + 1
        #: For the first suffix of a run the one before it, for the last the one after it; -1 where there is none.
        self.first, self.above = order[starts], np.where(starts > 0, order[starts - 1], -1)
        self.last, self.below = order[ends], np.where(ends < len(text) - 1, order[np.minimum(ends + 1, len(text) - 1)], -1)

    def _streamed(self, places: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Matches at sampled places by comparison; from each place on they lose a byte a step."""
        n, text = len(self.text), self.text
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        match = np.zeros(len(places), np.int64)
        active = np.flatnonzero(others >= 0)
        while len(active):
            a, b = places[active] + match[active], others[active] + match[active]
            room = n - np.maximum(a, b)
            differ = words[np.minimum(a, n - 1)] != words[np.minimum(b, n - 1)]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
            step = np.minimum(same, np.maximum(room, 0))
            match[active] += step
            active = active[step == 8]
        order = np.argsort(places)
        places, match = places[order], match[order]
        at = np.searchsorted(places, np.arange(n), "right") - 1
        return np.where(at >= 0, match[at] - (np.arange(n) - places[at]), 0)

    def matching_statistics(self) -> np.ndarray:
        """For every place of the text the longest match that starts anywhere else."""
        return np.maximum(self._streamed(self.first, self.above), self._streamed(self.last, self.below))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling the compared length of those that are still equal."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    # eight bytes, and after them how many of them are in the text, so that an end sorts first
    key = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)
    room = np.minimum(n - np.arange(n), 8)
    order = np.lexsort((room, key)) if n < 8 or not text.all() else np.argsort(key)
    sorted_key, sorted_room = key[order], room[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (sorted_room[1:] != sorted_room[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, sizes)  # the first place of the equals
    place = np.flatnonzero(np.repeat(sizes > 1, sizes))
    own, width = order[place], 8
    while len(place):  # only what is still equal is sorted again
        ahead = own + width
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = (rank[own].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        by = np.argsort(both)
        own, both = own[by], both[by]
        order[place] = own
        new = np.ones(len(own), bool)
        new[1:] = both[1:] != both[:-1]
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(own)))
        rank[own] = np.repeat(place[heads], sizes)
        tied = np.repeat(sizes > 1, sizes)
        place, own, width = place[tied], own[tied], 2 * width
    return order


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part the starts of windows that also start elsewhere in the parts."""
    text = np.frombuffer(b"\xff".join([*parts, b""]), np.uint8)
    matches = RunLengthIndex(text).matching_statistics()
    out, at = [], 0
    for part in parts:
        out.append(np.flatnonzero(matches[at : at + max(len(part) - length + 1, 0)] >= length))
        at += len(part) + 1
    return out


def _runs(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of every run of consecutive numbers."""
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()


PIECES = "core long, piece long, block long, seq long, row int, start int, n int"


def _all_pieces(blocks: Blocks, column: int, length: int) -> DataFrame:
    def find(block, batches):
        for seq, data in batches:
            raw, at = string_buffers(unpack(data).column(column))
            for row, stop in steps_of(at, STEP_BYTES):
                text, start, n, core, piece = pieces(raw[at[row] : at[stop]], at[row : stop + 1] - at[row], length)
                m = len(text)
                if m:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(core.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(np.full(m, block)), pa.array(np.full(m, seq)),
                         pa.array(text + row, pa.int32()), pa.array(start, pa.int32()), pa.array(n, pa.int32())],
                        ["core", "piece", "block", "seq", "row", "start", "n"],
                    )

    return blocks.arrow_frame(blocks.each(find), PIECES)


def _bytes_of(blocks: Blocks, column: int, wanted: DataFrame, length: int) -> DataFrame:
    """(core, piece, data) for wanted pieces (core, piece, block, seq, row, start, n)."""

    def cut(_, batches, values):
        by_seq: dict[int, list] = {}
        for seq, *rest in values:
            by_seq.setdefault(seq, []).append(rest)
        for seq, data in batches:
            if seq not in by_seq:
                continue
            raw, at = string_buffers(unpack(data).column(column))
            rows = by_seq[seq]
            for k in range(0, len(rows), 4096):
                part = rows[k : k + 4096]
                found = [raw[at[r] + s : at[r] + s + n - 1 + length].tobytes() for _, _, r, s, n in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array(found, pa.binary())],
                    ["core", "piece", "data"],
                )

    rows = wanted.select("block", "seq", "core", "piece", "row", "start", "n").rdd.map(lambda r: (r[0], tuple(r[1:])))
    return blocks.arrow_frame(blocks.beside(rows, cut), "core long, piece long, data binary")


def _indexed(length: int):
    """Rows (piece, first, last) of repeated window starts, for batches in order of core."""

    def index(batches):
        held, size, core = [], 0, None

        def flush():
            found = repeated_starts([d for _, d in held], length)
            rows = [(p, a, b) for (p, _), starts in zip(held, found) for a, b in zip(*_runs(starts))]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
                ["piece", "first", "last"],
            )

        for batch in batches:
            for c, p, d in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if c != core and size >= INDEX_BYTES:
                    yield flush()
                    held, size = [], 0
                core = c
                held.append((p, d))
                size += len(d)
        if held:
            yield flush()

    return index


def _window_rows(length: int):
    """Rows (window, piece, at) for every window of pieces (core, piece, data)."""

    def windows(batches):
        for batch in batches:
            for core, piece, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = np.frombuffer(data, np.uint8)
                at = np.arange(len(raw) - length + 1)
                hashes = mixed(Substrings(raw).of(at, at + length) + np.uint64(core & (2**64 - 1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), piece)), pa.array(at, pa.int32())], ["window", "piece", "at"]
                )

    return windows


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, Blocks]:
    """Rows (block, seq, row, start, end) of repeated bytes, overlapping ones included, and the blocks of the rows."""
    blocks = Blocks(docs, id_col, text_col)
    column = docs.columns.index(text_col)
    every = stored(_all_pieces(blocks, column, length), "pieces")
    cores = every.groupBy("core").agg(F.count("*").alias("m"), F.min("piece").alias("a"), F.max("piece").alias("b"))
    cores = stored(cores.where("m > 1").select("core", (F.col("a") != F.col("b")).alias("mixed")), "shared-cores")
    shared = stored(every.join(cores, "core"), "shared-pieces")
    kinds = stored(
        shared.groupBy("core", "piece").agg(
            F.count("*").alias("m"), F.first("mixed").alias("mixed"),
            F.min(F.struct("block", "seq", "row", "start", "n")).alias("place"),
        ), "piece-kinds",
    )
    # 1. whole pieces that occur again
    whole = kinds.where("m > 1").select("piece", F.lit(0).alias("first"), (F.col("place.n") - 1).cast("int").alias("last"))
    # 2. and 3. different pieces with one core
    several = kinds.where("mixed").select("core", "piece", "m", "place.*")
    sizes = stored(several.groupBy("core").agg(F.count("*").alias("different")), "core-sizes")
    text_of = stored(_bytes_of(blocks, column, several, length).join(sizes, "core"), "piece-bytes")
    few = text_of.where(F.col("different") <= MANY).select("core", "piece", "data")
    indexed = few.repartition("core").sortWithinPartitions("core").mapInArrow(_indexed(length), "piece long, first int, last int")
    windows = text_of.where(F.col("different") > MANY).select("core", "piece", "data").mapInArrow(_window_rows(length), "window long, piece long, at int")
    windows = stored(windows, "windows")
    again = windows.groupBy("window").agg(F.count("*").alias("m")).where("m > 1").select("window")
    grouped = windows.join(again, "window").select("piece", F.col("at").alias("first"), F.col("at").alias("last"))
    marks = stored(whole.union(indexed).union(grouped), "marks")
    spans = shared.join(marks, "piece").select(
        "block", "seq", "row", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + length).alias("end")
    )
    return stored(spans, "repeated-spans"), blocks


def cleaned(blocks: Blocks, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row with its remaining bytes."""
    i_id, i_text = blocks.schema.names.index(id_col), blocks.schema.names.index(text_col)

    def remove(_, batches, values):
        by_seq: dict[int, list] = {}
        for seq, row, start, end in values:
            by_seq.setdefault(seq, []).append((row, start, end))
        for seq, data in batches:
            batch = unpack(data)
            raw, at = string_buffers(batch.column(i_text))
            change = np.zeros(len(raw) + 1, np.int32)
            rows = np.array(by_seq.get(seq, []), np.int64).reshape(-1, 3)
            np.add.at(change, at[rows[:, 0]] + rows[:, 1], 1)
            np.add.at(change, at[rows[:, 0]] + rows[:, 2], -1)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.concatenate([[0], np.cumsum(gone)])
            n_removed = removed[at[1:]] - removed[at[:-1]]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            firsts = at[:-1][np.diff(at) > 0]
            begins[firsts] = gone[firsts]
            n_begins = np.concatenate([[0], np.cumsum(begins)])
            kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i_id).cast(pa.int64()), pa.array(np.diff(at)), pa.array(n_removed), pa.array(n_begins[at[1:]] - n_begins[at[:-1]]),
                 pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    rows = spans.select("block", "seq", "row", "start", "end").rdd.map(lambda r: (r[0], tuple(r[1:])))
    return blocks.arrow_frame(blocks.beside(rows, remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row.

    A null text is empty.  A byte goes if a string of ``length`` bytes that covers it
    starts anywhere else too, in the same text or another; repeated rows are texts of
    their own, so they lose all bytes if they are long enough.  Texts shorter than
    ``length`` stay.  Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans, blocks = repeated_spans(docs, "doc_id", "text", length)
    return cleaned(blocks, spans, "doc_id", "text")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )

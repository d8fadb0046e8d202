"""Directly addressable token files (operator 7).

Ids are cut into chunks of eight bits.  Level 0 holds the lowest chunk of every
id, level k the k-th chunk of those ids that need one; a bitmap per level says
which ids go on, and a rank directory counts the set bits before every 512th
position.  So the token at any position is read with one step per level, without
decoding a block.

A file is a run of segments; a segment holds whole documents::

    magic "DAC1" | u32 levels | u64 documents | u64 ids | u64 bytes after this header
    i64 document id, u8 id is null, u64 number of ids     (a column each)
    per level: u64 entries | u32 ranks | bitmap | chunks   (the last level has no ranks and bitmap)

and ends in a line feed.  Files are written by Spark's text sink, which passes
bytes through, and read by its binary source, so any file system Spark knows will
do and lost tasks are simply run again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from inkwell.llm.common import scratch, stored, table
from inkwell.llm.tokens import encoder, sliced

MAGIC = b"DAC1"
HEADER = struct.Struct("<4sIQQQ")
RANK_STEP = 512
#: A segment is closed when it holds so many ids; one document is never divided.
SEGMENT_IDS = 1 << 20


def encode_segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment, with its closing line feed left to the writer."""
    body = [
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        counts.astype("<u8").tobytes(),
    ]
    levels, values = 0, ids.astype(np.uint32)
    while True:
        levels += 1
        rest = values >> 8
        more = rest > 0
        body.append(struct.pack("<Q", len(values)))
        if more.any():
            blocks = np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.uint32)
            body += [(np.cumsum(blocks, dtype=np.uint32) - blocks).astype("<u4").tobytes(), np.packbits(more, bitorder="little").tobytes()]
        body.append((values & 0xFF).astype("u1").tobytes())
        if not more.any():
            break
        values = rest[more]
    data = b"".join(body)
    return HEADER.pack(MAGIC, levels, len(doc_ids), len(ids), len(data)) + data


class Segment:
    """Random access to one segment that starts at a place of a file's bytes."""

    def __init__(self, data, place: int = 0):
        magic, n_levels, n_docs, self.n_ids, size = HEADER.unpack_from(data, place)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {place}")
        at = place + HEADER.size
        self.end = at + size + 1

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null_ids, counts = column("<i8", n_docs), column("u1", n_docs), column("<u8", n_docs)
        self.offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.levels = []
        for k in range(n_levels):
            n = int(column("<u8", 1)[0])
            last = k == n_levels - 1
            ranks = None if last else column("<u4", -(-n // RANK_STEP))
            bits = None if last else column("u1", -(-n // 8))
            self.levels.append((n, ranks, bits, column("u1", n)))

    def token(self, i: int) -> int:
        """The id at position i, by one step per level."""
        value = 0
        for k, (_, ranks, bits, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if bits is None or not (bits[i >> 3] >> (i & 7)) & 1:
                break
            first = i // RANK_STEP * RANK_STEP
            head = bits[first >> 3 : i >> 3]
            i = int(ranks[i // RANK_STEP]) + int(np.bitwise_count(head).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All ids of the segment."""
        out, at = np.zeros(self.n_ids, "<u4"), None
        for k, (n, _, bits, chunks) in enumerate(self.levels):
            part = chunks.astype(np.uint32) << np.uint32(8 * k)
            if at is None:
                out[:] = part
            else:
                out[at] |= part
            if bits is not None:
                more = np.unpackbits(bits, count=n, bitorder="little").view(bool)
                at = np.flatnonzero(more) if at is None else at[more]
        return out


def segments(data) -> Iterator[Segment]:
    place = 0
    while place < len(data):
        segment = Segment(data, place)
        place = segment.end
        yield segment


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> None:
    """Write the ids of every text, each with ``end_id`` after it, in ascending id order.

    Null texts are empty.  Null ids come first; rows of one id are ordered by the
    hash of their texts, and repeated rows are written repeatedly.  Other columns are ignored.
    """

    def encode(batches):
        with_end = encoder(tokenizer)
        docs_held, counts_held, ids_held, held = [], [], [], 0

        def segment():
            nonlocal docs_held, counts_held, ids_held, held
            data = encode_segment(docs_held, np.concatenate(counts_held), np.concatenate(ids_held))
            docs_held, counts_held, ids_held, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["segment"])

        for batch in sliced(batches):
            ids, offsets = with_end.encode(batch.column(1))
            ids = np.insert(ids, offsets[1:], np.uint32(end_id))
            offsets = offsets + np.arange(len(offsets))
            names, row = batch.column(0).to_pylist(), 0
            while row < len(names):
                stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT_IDS - held, "left")))
                stop = min(stop, len(names))
                docs_held += names[row:stop]
                counts_held.append(np.diff(offsets[row : stop + 1]))
                ids_held.append(ids[offsets[row] : offsets[stop]])
                held += int(offsets[stop] - offsets[row])
                row = stop
                if held >= SEGMENT_IDS:
                    yield segment()
        if docs_held:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    (
        ordered.mapInArrow(encode, "segment binary").select(F.col("segment").cast("string").alias("value"))
        .write.option("lineSep", "\n").text(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row per document: part, seq (order in the part), doc_id, n_tokens, offset (in the part), ids_crc32."""

    def decode(batches):
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                seq = base = 0
                for segment in segments(content.as_buffer() or b""):
                    ids = memoryview(segment.ids().view("u1"))
                    at = segment.offsets
                    n = len(at) - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(seq, seq + n)),
                            pa.array(segment.doc_ids, pa.int64(), mask=segment.null_ids.astype(bool)),
                            pa.array(np.diff(at), pa.int64()), pa.array(base + at[:-1], pa.int64()),
                            pa.array([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64()),
                        ],
                        ["part", "seq", "doc_id", "n_tokens", "offset", "ids_crc32"],
                    )
                    seq, base = seq + n, base + int(at[-1])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(
        F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"part-(\d+)", 1).cast("long").alias("part"), "content"
    ).mapInArrow(decode, "part long, seq long, doc_id long, n_tokens long, offset long, ids_crc32 long")


def documents_in(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files with ``start``, the number of ids before them in all files."""
    rows = stored(read_token_files(spark, path), "token-index")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "part").withColumn("start", F.col("base") + F.col("offset"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return documents_in(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")

"""Documents dealt to blocks and shuffled once, for operators that pass over them several times."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, functions as F

from inkwell.llm.shingles import mixed
from inkwell.llm.tokens import release, sliced

#: Bytes of text that a block is meant to hold.
BLOCK_BYTES = 32 << 20


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_next_batch()


class Blocks:
    """Rows of a DataFrame in blocks by the hash of an id, in compressed batches, shuffled once.

    Every pass reads the same shuffle files; Spark writes lost ones again.  A row is
    named by (block, seq, row): its block, its batch and its place there.  ``side`` rows
    (one long column) go to the blocks of equal ids, as batches with seq -1.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, side: DataFrame | None = None):
        self.spark, self.schema = docs.sparkSession, docs.schema
        size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
        self.n = n = max(1, -(-size // BLOCK_BYTES))
        place = docs.columns.index(id_col)

        def dealt(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
            ids = np.asarray(batch.column(column).fill_null(0)).astype(np.int64)
            block = (mixed(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(part):
                    yield int(block[part[0]]), batch.take(pa.array(part))

        def packed(column: int, numbered: bool):
            def pack_rows(batches):
                release()
                seq = TaskContext.get().partitionId() << 32 if numbered else -1
                for batch in sliced(batches, 4096):
                    for block, part in dealt(batch, column):
                        seq += numbered
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([seq]), pa.array([pack(part)], pa.binary())], ["block", "seq", "data"])

            return pack_rows

        kinds = "block long, seq long, data binary"
        rows = docs.mapInArrow(packed(place, True), kinds)
        if side is not None:
            rows = rows.union(side.mapInArrow(packed(0, False), kinds))
        self.shuffled = rows.rdd.map(lambda r: (r[0], (r[1], bytes(r[2])))).partitionBy(n)

    def frame(self, rdd: RDD, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rdd, schema)

    def arrow_frame(self, batches: RDD, schema) -> DataFrame:
        """A DataFrame of an RDD of record batches."""

        def read(chunks):
            for chunk in chunks:
                for data in chunk.column(0):
                    yield unpack(data.as_py())

        return self.frame(batches.map(lambda b: (pack(b),)), "data binary").mapInArrow(read, schema)

    def each(self, work: Callable) -> RDD:
        """work(block, batches) for every block; batches is a list of (seq, packed batch)."""

        def run(values):
            release()
            by_block: dict[int, list] = {}
            for block, value in values:
                by_block.setdefault(block, []).append(value)
            for block, own in by_block.items():
                yield from work(block, own)

        return self.shuffled.mapPartitions(run)

    def beside(self, rows: RDD, work: Callable) -> RDD:
        """work(block, batches, values) for every block and the values of rows (block, value)."""
        return self.shuffled.cogroup(rows.partitionBy(self.n), self.n).flatMap(
            lambda item: work(item[0], list(item[1][0]), list(item[1][1])) if item[1][0] else ()
        )

    def without(self, rejected: DataFrame) -> DataFrame:
        """The rows but those named by (block, seq, row)."""

        def keep(_, batches, named):
            drop: dict[int, list[int]] = {}
            for seq, row in named:
                drop.setdefault(seq, []).append(row)
            for seq, data in batches:
                if seq >= 0:
                    batch = unpack(data)
                    stay = np.ones(batch.num_rows, bool)
                    stay[drop.get(seq, [])] = False
                    if stay.any():
                        yield batch.filter(pa.array(stay))

        return self.arrow_frame(self.beside(rejected.rdd.map(lambda r: (r[0], (r[1], r[2]))), keep), self.schema)

"""Best-fit-decreasing packing of token pieces into sequences (operator 3).

Lengths are whole numbers up to the capacity, so best-fit decreasing needs only
the number of pieces of each length.  The plan keeps open bins as ranges with
one remaining capacity; a segment tree over the remaining capacities finds the
tightest one that fits in logarithmic time, and a whole range is filled in one
step.  Piece r of a length then finds its place by its rank alone.  The driver
holds one count per length and the plan's steps, at most a few per length and
open capacity, however many documents there are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from inkwell.llm.common import stored, table
from inkwell.llm.token_files import tokenizer_path
from inkwell.llm.tokens import encoder, sliced

CAPACITY = 2048


class TightestBin:
    """A segment tree over remaining capacities: how many ranges of bins are open at each."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.width)

    def add(self, remaining: int, change: int) -> None:
        node = self.width + remaining
        while node:
            self.open[node] += change
            node //= 2

    def find(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that has an open bin."""
        node = self.width + length
        if self.open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.width
            node //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Steps (length, first_rank, per_bin, first_bin, offset): the pieces of a length from first_rank
    on go to bins from first_bin on, per_bin into each, the first of them at offset."""
    tree, ranges, steps, bins = TightestBin(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            ranges[remaining].append((first, n))
            tree.add(remaining, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.find(length)
            if remaining is None:  # no open bin fits
                remaining = capacity
                first, n = bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = ranges[remaining].pop()
                tree.add(remaining, -1)
            per_bin = remaining // length
            full, partly = min(n, left // per_bin), 0
            if full < n:
                partly = left - full * per_bin
            steps.append((length, rank, per_bin, first, capacity - remaining))
            put(remaining - per_bin * length, first, full)
            if partly:
                put(remaining - partly * length, first + full, 1)
            untouched = n - full - bool(partly)
            put(remaining, first + n - untouched, untouched)
            rank, left = rank + full * per_bin + partly, left - full * per_bin - partly
    return np.array(steps, np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int, length_col: str = "length") -> DataFrame:
    """Add sequence_id and offset to pieces with lengths from 1 to the capacity.

    Pieces of equal length are placed in the order of the written table.  No pieces
    give no rows; repeated rows are packed as often as they occur.
    """
    spark, columns = pieces.sparkSession, pieces.columns

    def ranked(batches):
        chunk, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            lengths = np.asarray(batch.column(batch.schema.get_field_index(length_col)))
            order = np.argsort(lengths, kind="stable")
            run = lengths[order]
            first = np.searchsorted(run, run, "left")
            rank = np.empty(len(run), np.int64)
            rank[order] = np.arange(len(run)) - first + seen[run]
            seen += np.bincount(lengths, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(run), chunk), pa.int64()), pa.array(rank)],
                [*batch.schema.names, "_chunk", "_rank"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    rows = stored(pieces.mapInArrow(ranked, f"{kinds}, _chunk long, _rank long"), "pieces")
    counts = stored(rows.groupBy(length_col, "_chunk").agg(F.count("*").alias("n")), "lengths")
    totals = {r[0]: r[1] for r in counts.groupBy(length_col).agg(F.sum("n")).collect()}  # a row per length
    steps = best_fit_plan(totals, capacity)
    keys = (steps[:, 0] << 44) | steps[:, 1]
    order = np.argsort(keys)
    plan = spark.sparkContext.broadcast((keys[order], steps[order]))

    def placed(batches):
        keys, steps = plan.value
        for batch in batches:
            field = batch.schema.get_field_index
            lengths, rank = np.asarray(batch.column(field(length_col))), np.asarray(batch.column(field("_at")))
            step = steps[np.searchsorted(keys, (lengths.astype(np.int64) << 44) | rank, "right") - 1]
            place = rank - step[:, 1]
            at = step[:, 4] + place % step[:, 2] * lengths
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(field(c)) for c in columns), pa.array(step[:, 3] + place // step[:, 2]), pa.array(at, pa.int64())],
                [*columns, "sequence_id", "offset"],
            )

    before = Window.partitionBy(length_col).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(length_col, "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    at = rows.join(bases, [length_col, "_chunk"]).withColumn("_at", F.col("_base") + F.col("_rank"))
    return at.select(*columns, "_at").mapInArrow(placed, f"{kinds}, sequence_id long, offset long")


def cut_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null text is empty and has the end id alone.  Only documents longer than the
    capacity are cut; then the first piece may be shorter.  Ids are little-endian
    unsigned 32-bit numbers.  Other columns are ignored.
    """

    def cut(batches):
        encode = encoder(tokenizer).encode
        for batch in sliced(batches):
            ids, at = encode(batch.column(1))
            ids = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4")
            at = at + np.arange(len(at))
            total = np.diff(at)
            n = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            first = (total - (n - 1) * capacity)[doc]
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            data, begin = memoryview(ids.view("u1")), (at[doc] + start).tolist()
            parts = [data[4 * b : 4 * (b + k)] for b, k in zip(begin, length.tolist())]
            columns = [
                batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenized documents in as few sequences as best-fit decreasing needs."""
    return pack(cut_documents(docs, tokenizer, capacity, with_ids=with_ids), capacity)


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())

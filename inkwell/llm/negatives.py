"""Hard negatives by angular triangle filtering (operator 12).

Components become integers, so that scores are exact.  A bounded sample fits a few
reference directions; every vector stores its angles to them.  For an anchor at
angle s and a vector at angle t from one reference, the angle between the two lies
in [|s - t|, min(s + t, 2 pi - s - t)].  The narrowest interval over all references
gives cosine limits, and the norms turn them into score limits, widened against
rounding.  Vectors are ordered by label, nearest reference and angle and cut into
blocks, which keep ranges of angles, norms and labels.  Anchors meet only the blocks
whose score limits reach what the anchor can still use, and within a block only the
window of angles to its own reference that can: those vectors are scored with
integers, the others never.  The best scores within the sample are the first limits,
so pruning starts before any block is read; it changes the work, never the result.

The anchors are a stated query set; they meet the rows in blocks of bounded size, by
(group of blocks, chunk of anchors), and hand on at most the asked number of rows per
block group.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component, take no part, nor do rows whose scaled components reach the limit beyond
which a score might not fit a long (about 2**31 / sqrt(length)).  Shorter vectors
count as filled up with zeros; zero and empty vectors score 0 with all.  Of rows with
one id, the one with the least (label, vector) counts.  Other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from inkwell.llm.common import stored, table

#: Positives and negatives of an anchor; percentages of the positive's score that bound a negative's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Factor of the components.
SCALE = 256
#: About so many vectors fit the references and give the first limits; reference directions.
SAMPLE, REFERENCES = 4096, 16
#: Vectors of a block, of a group of blocks, anchors of a block, of a chunk.
BLOCK, GROUP, ANCHOR_BLOCK, CHUNK = 1024, 16_384, 256, 16_384
#: Widening of score limits against rounding: relative to the product of norms, and absolute.
SLACK = 1e-6
INT = np.iinfo(np.int64)


def usable(rows: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """vec_id, label and integer codes of the rows that take part, one per id, and the greatest length."""
    length = rows.agg(F.max(F.size(F.coalesce("embedding", F.array())))).first()[0] or 1
    length = max(1, length)
    limit = math.isqrt((1 << 62) // length)
    limit = float(min(limit, (1 << 31) - 1) - 1)
    fits = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < limit))
    codes = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    own = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fits).select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), codes.alias("codes")
    )
    own = stored(own, "codes")
    twice = own.groupBy("vec_id").count().where("count > 1").select("vec_id")
    one = own.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "codes")).alias("least"))
    return own.join(twice, "vec_id", "left_anti").unionByName(one.select("vec_id", "least.label", "least.codes")), length


def matrix(lists: pa.Array, length: int) -> np.ndarray:
    """Lists of integers as rows of a matrix, filled up with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), length), np.int64)
    out[np.arange(length)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def angles(codes: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles to the references and norms; zero vectors stand at right angles."""
    real = codes.astype(float)
    norms = np.sqrt((real * real).sum(1))
    cosines = real @ references.T / np.where(norms, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1)), norms


def fit_references(codes: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Directions spread over a sample: the farthest vector each time, then four rounds of means."""
    real = codes[np.any(codes, axis=1)].astype(float)
    if not len(real):
        return np.eye(1, codes.shape[1])
    real /= np.sqrt((real * real).sum(1))[:, None]
    chosen = [real[0]]
    nearest = real @ chosen[0]
    while len(chosen) < min(count, len(real)) and nearest.min() < 1 - 1e-9:
        chosen.append(real[nearest.argmin()])
        nearest = np.maximum(nearest, real @ chosen[-1])
    out = np.array(chosen)
    for _ in range(4):
        own = (real @ out.T).argmax(1)
        for r in range(len(out)):
            mean = real[own == r].sum(0) if (own == r).any() else out[r]
            size = math.sqrt(mean @ mean)
            out[r] = mean / size if size > 1e-9 else out[r]
    return out


def score_limits(a_low, a_high, a_norms, v_low, v_high, v_norms) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible scores between ranges of angles (last axis: references) and of norms (low, high)."""
    apart = np.maximum(0, np.maximum(a_low - v_high, v_low - a_high)).max(-1)
    least, most = a_low + v_low, a_high + v_high
    widest = np.where(most <= np.pi, most, np.where(least >= np.pi, 2 * np.pi - least, np.pi)).min(-1)
    high, low = np.cos(np.minimum(apart, np.pi)), np.cos(np.clip(widest, 0, np.pi))
    small, large = a_norms[0] * v_norms[0], a_norms[1] * v_norms[1]
    slack = 1 + SLACK * large
    return np.minimum(low * small, low * large) - slack, np.maximum(high * small, high * large) + slack


def exact_scores(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where every partial sum stays below 2**53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(v).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ v.T.astype(float)).astype(np.int64)
    return a @ v.T


class Best:
    """The best (score, id) pairs of one list: higher scores first, then smaller ids."""

    __slots__ = ("count", "low", "high", "scores", "ids")

    def __init__(self, count: int, low: int, high: int):
        self.count, self.low, self.high = count, low, high
        self.scores = self.ids = np.empty(0, np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        found = np.flatnonzero((scores >= self.low) & (scores <= self.high))
        if len(found):
            scores, ids = np.concatenate([self.scores, scores[found]]), np.concatenate([self.ids, ids[found]])
            order = np.lexsort((ids, -scores))[: self.count]
            self.scores, self.ids = scores[order], ids[order]
            self.raise_low(self.scores)

    def raise_low(self, scores: np.ndarray) -> None:
        """Nothing below the last of a full list is wanted any more."""
        if len(scores) == self.count:
            self.low = max(self.low, int(scores[-1]))


class Anchors:
    """A block of anchors with what each of them still wants."""

    def __init__(self, ids, labels, codes, theta, norms, wanted, same_label):
        self.ids, self.labels, self.codes, self.theta, self.norms = ids, labels, codes, theta, norms
        self.wanted, self.same_label = wanted, same_label
        self.refresh()

    def refresh(self) -> None:
        """The scores that any list of an anchor still takes; an anchor without a list takes none."""
        self.low = np.array([min((b.low for b in own if b.low <= b.high), default=INT.max) for own in self.wanted], float)
        self.high = np.array([max((b.high for b in own if b.low <= b.high), default=INT.min) for own in self.wanted], float)

    def reach(self, labels: tuple[int, int], v_low, v_high, v_norms) -> np.ndarray:
        """Which anchors may want something of a range of vectors."""
        if self.same_label:
            fits = (self.labels >= labels[0]) & (self.labels <= labels[1])
        else:
            fits = (self.labels != labels[0]) | (labels[0] != labels[1])
        low, high = score_limits(self.theta, self.theta, (self.norms, self.norms), v_low, v_high, v_norms)
        return fits & (high >= self.low) & (low <= self.high)

    def meet(self, block: "Vectors") -> int:
        """Score the window of a block that the anchors can reach; returns the number of scores."""
        rows = np.flatnonzero(self.reach(block.label_range, block.low, block.high, block.norm_range))
        if not len(rows):
            return 0
        theta, most = self.theta[rows, block.reference], self.norms[rows] * block.norm_range[1]
        # a score of at least low > 0 needs an angle of at most `reach` to the anchor, so as much to its angle at the reference
        low = self.low[rows]
        least = (low - 1) / np.where(most > 0, most, 1) - SLACK
        reach = np.where((most > 0) & (low > 1), np.arccos(np.clip(least, -1, 1)), np.pi) + SLACK
        start = np.searchsorted(block.theta, (theta - reach).min(), "left")
        end = np.searchsorted(block.theta, (theta + reach).max(), "right")
        if start == end:
            return 0
        scores = exact_scores(self.codes[rows], block.codes[start:end])
        ids, labels = block.ids[start:end], block.labels[start:end]
        for k, row in enumerate(rows):
            fits = (labels == self.labels[row]) == self.same_label
            if self.same_label:
                fits &= ids != self.ids[row]
            for best in self.wanted[row]:
                best.take(scores[k][fits], ids[fits])
        self.refresh()
        return scores.size


class Vectors:
    """A block of vectors in the order of their angles to the reference that most are nearest to."""

    def __init__(self, ids, labels, codes, theta, norms):
        self.reference = int(np.bincount(theta.argmin(1)).argmax())
        order = np.lexsort((ids, theta[:, self.reference]))
        self.ids, self.labels, self.codes = ids[order], labels[order], _narrow(codes[order])
        self.theta = theta[order, self.reference]
        self.low, self.high = theta.min(0), theta.max(0)
        self.norm_range = float(norms.min()), float(norms.max())
        self.label_range = int(labels.min()), int(labels.max())


def _narrow(codes: np.ndarray) -> np.ndarray:
    """The same codes in the smallest integer type, for storing."""
    most = int(np.abs(codes).max(initial=0))
    return codes.astype(np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32)


def _in_order(points: DataFrame, references: np.ndarray, length: int, size: int, count: int, extra: str = "") -> DataFrame:
    """Points range-partitioned and sorted by label, nearest reference, angle and id, with angles and norm."""
    names = [f.name for f in points.schema.fields]

    def measured(batches):
        for batch in batches:
            theta, norms = angles(matrix(batch["codes"], length), references)
            nearest = theta.argmin(1) if len(theta) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(theta[np.arange(len(theta)), nearest])],
                [*batch.schema.names, "cell", "angle"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    placed = points.mapInArrow(measured, f"{kinds}, cell int, angle double")
    keys = ["label", "cell", "angle", "vec_id"]
    return placed.repartitionByRange(max(1, -(-count // size)), *keys).sortWithinPartitions(*keys).select(*names)


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Consecutive rows in tables of a given size, across batches; the last may be smaller."""
    held, rows = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - rows)
            held.append(part)
            at, rows = at + part.num_rows, rows + part.num_rows
            if rows == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _blocks(points: DataFrame, references: np.ndarray, length: int, count: int) -> DataFrame:
    """(part, ranges, body): all vectors in blocks; ``part`` numbers the groups of blocks."""

    def cut(batches):
        part = TaskContext.get().partitionId()
        for run in _runs(batches, BLOCK):
            codes = matrix(run["codes"], length)
            block = Vectors(run["vec_id"].to_numpy(), run["label"].to_numpy(), codes, *angles(codes, references))
            ranges = [block.low.tolist(), block.high.tolist(), [*block.norm_range], [*block.label_range]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), *(pa.array([r]) for r in ranges), pa.array([pickle.dumps(block)], pa.binary())],
                ["part", "low", "high", "norms", "labels", "body"],
            )

    kinds = "part int, low array<double>, high array<double>, norms array<double>, labels array<long>, body binary"
    return _in_order(points, references, length, GROUP, count).mapInArrow(cut, kinds)


def _anchor_blocks(anchors: DataFrame, references: np.ndarray, length: int, count: int, sample: tuple, lists) -> DataFrame:
    """(chunk, ranges, body): anchors in blocks, with the limits that the sample gives."""
    same_label = "windows" not in anchors.columns

    def cut(batches):
        chunk = TaskContext.get().partitionId()
        for number, run in enumerate(_runs(batches, ANCHOR_BLOCK)):
            codes = matrix(run["codes"], length)
            windows = [None] * len(codes) if same_label else run["windows"].to_pylist()
            block = Anchors(
                run["vec_id"].to_numpy(), run["label"].to_numpy(), codes, *angles(codes, references),
                [lists(w) for w in windows], same_label,
            )
            scores = exact_scores(codes, sample[2])
            for k, own in enumerate(block.wanted):
                fits = (sample[1] == block.labels[k]) == same_label
                if same_label:
                    fits &= sample[0] != block.ids[k]
                for best in own:
                    within = scores[k][fits]
                    within = within[(within >= best.low) & (within <= best.high)]
                    if len(within) >= best.count:
                        best.raise_low(-np.sort(-within)[: best.count])
            block.refresh()
            norms = [float(block.norms.min()), float(block.norms.max())]
            bounds = [float(block.low.min()), float(block.high.max())]
            labels = [int(block.labels.min()), int(block.labels.max())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk], pa.int32()), pa.array([(chunk << 32) + number], pa.int64()),
                    *(pa.array([r]) for r in (block.theta.min(0).tolist(), block.theta.max(0).tolist(), norms, labels, bounds)),
                    pa.array([pickle.dumps(block)], pa.binary()),
                ],
                ["chunk", "anchor_block", "low", "high", "norms", "labels", "bounds", "body"],
            )

    kinds = "chunk int, anchor_block long, low array<double>, high array<double>, norms array<double>, labels array<long>, bounds array<double>, body binary"
    return _in_order(anchors, references, length, CHUNK, count).mapInArrow(cut, kinds)


def _met(blocks: DataFrame, anchors: DataFrame, same_label: bool, schema: str, emit) -> DataFrame:
    """Anchor blocks against the groups of blocks that their limits reach; ``emit`` rows of every met pair."""
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    chunks = (anchors.agg(F.max("chunk")).first()[0] or 0) + 1
    places = range(len((blocks.select("low").first() or [[]])[0]))
    extreme = lambda how, name: F.array(*(how(F.col(name)[i]) for i in places)).alias(f"v_{name}")
    ranges = blocks.groupBy("part").agg(
        extreme(F.min, "low"), extreme(F.max, "high"), F.array(F.min(F.col("norms")[0]), F.max(F.col("norms")[1])).alias("v_norms"),
        F.array(F.min(F.col("labels")[0]), F.max(F.col("labels")[1])).alias("v_labels"),
    )
    names = ["low", "high", "norms", "v_low", "v_high", "v_norms"]
    tried = anchors.select("anchor_block", "low", "high", "norms", "labels", "bounds", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def reached(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a_low, a_high, a_norms, v_low, v_high, v_norms, labels, v_labels, bounds = (np.array(batch[n].to_pylist()) for n in [*names, "labels", "v_labels", "bounds"])
            low, high = score_limits(a_low, a_high, a_norms.T, v_low, v_high, v_norms.T)
            stay = (high >= bounds[:, 0]) & (low <= bounds[:, 1])
            if same_label:
                stay &= (labels[:, 0] <= v_labels[:, 1]) & (v_labels[:, 0] <= labels[:, 1])
            else:
                stay &= ~((labels[:, 0] == labels[:, 1]) & (v_labels[:, 0] == v_labels[:, 1]) & (labels[:, 0] == v_labels[:, 0]))
            yield pa.RecordBatch.from_arrays([batch["anchor_block"], batch["part"]], ["anchor_block", "part"]).filter(pa.array(stay))

    pairs = tried.join(ranges, "part").mapInArrow(reached, "anchor_block long, part int")
    sent = pairs.join(anchors.select("anchor_block", "chunk", F.col("body").alias("anchors")), "anchor_block")
    wide = blocks.select("part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "body")

    def compare(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked):
            held = [pickle.loads(b) for b in vectors["body"]]
            for body in asked["anchors"]:
                block = pickle.loads(body)
                for own in held:
                    block.meet(own)
                out += emit(block)
        return pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    by = ["part", "chunk"]
    return wide.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(compare, schema)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` have vec_id, label and embedding; ``is_anchor`` chooses the anchors by vec_id.
    An anchor's positives are its best other rows of its label; each gets the best rows of other labels
    whose score is between ``low`` and ``high`` percent of the positive's.
    """
    points, length = usable(rows.select("vec_id", "label", "embedding"), scale)
    points = stored(points, "points")
    count, asked = points.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    every = max(1, count // SAMPLE)
    fitted = points.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).limit(2 * SAMPLE).toArrow()
    sample = fitted["vec_id"].to_numpy(), fitted["label"].to_numpy(), matrix(fitted["codes"], length)
    references = fit_references(sample[2])

    blocks = stored(_blocks(points, references, length, count), "blocks")
    anchors = points.where(is_anchor)
    first = stored(
        _anchor_blocks(anchors, references, length, asked, sample, lambda _: [Best(positives, INT.min, INT.max)]), "anchors"
    )
    near = _met(
        blocks, first, True, "anchor_id long, positive_id long, positive_score long",
        lambda b: [(int(a), int(i), int(s)) for a, own in zip(b.ids, b.wanted) for s, i in zip(own[0].scores, own[0].ids)],
    )
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = stored(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"), "positives")

    def windows(pairs) -> list[Best]:
        """One list per positive, in the order of the pairs."""
        return [Best(negatives, -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in pairs]

    listed = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("windows"))
    second = stored(_anchor_blocks(anchors.join(listed, "vec_id"), references, length, asked, sample, windows), "anchors")
    far = _met(
        blocks, second, False, "anchor_id long, place int, negative_id long, negative_score long",
        lambda b: [(int(a), k, int(i), int(s)) for a, own in zip(b.ids, b.wanted) for k, best in enumerate(own) for s, i in zip(best.scores, best.ids)],
    )
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = listed.select(F.col("vec_id").alias("anchor_id"), F.posexplode("windows").alias("place", "w"))
    return found.join(named, ["anchor_id", "place"]).select(
        "anchor_id", F.col("w.positive_id").alias("positive_id"), "rank", "negative_id", F.col("w.positive_score").alias("positive_score"), "negative_score"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 100; labels of every seventh id move on by one."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM own a JOIN own b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

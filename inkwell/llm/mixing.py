"""Balanced mixing of sources by the cube method (operator 4).

Every source gets a target; target over size is the expected number of copies of
each of its documents.  Whole copies are certain, the fraction is an inclusion
probability.  The flight phase moves the probabilities of three documents at a
time along the null space of (documents, tokens) until one of them is 0 or 1, so
both totals of the source stay exact.  It runs over blocks of documents; the at
most two fractional documents of each block meet again in the next, much smaller
level.  At the last level two documents per source are left, the landing problem; what it
misses is made up by turning a few decided documents of that level.

Chance comes from hashes of the documents, so reruns agree.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from inkwell.llm.common import SPACE_CLASS, enclosed, stored, table

WEIGHTS = (3, 1, 2)
#: Documents of a source whose flight is one task.
BLOCK = 2_000
NEAR = 1e-9


def sizes(docs: DataFrame, text_col: str = "text"):
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^" + SPACE_CLASS[1:-1] + "]+")), F.lit(0)).cast("long")


def source_targets(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: ``share`` of all sizes by weight, no source above ``most`` times its size.

    Sources take the weights in turn, by code point, null last.  Giving excess to the
    sources below their limit until none is above is one common level per unit of
    weight, cut at each limit; the level is found from running sums over the sources
    in the order of limit per weight.  The windows hold one row per source.
    """
    by_source = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (number % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    ranked = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = ranked.rowsBetween(Window.unboundedPreceding, -1)
    rest = ranked.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # with all earlier sources at their limit, the level that the others would get
    level = (F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    fits = F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(every)
    # levels rise until the first source that stays within its limit, which fixes the common one
    return rows.withColumn("common", fits).select(
        "source", "source_size",
        F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("common") * F.col("weight"))).alias("target"),
    )


def flight(units: list[list[float]], rng: random.Random) -> None:
    """Move the probabilities of [size, p] units until at most two are fractional; both totals stay."""
    active: list[list[float]] = []
    waiting = iter([u for u in units if NEAR < u[1] < 1 - NEAR])
    while True:
        while len(active) < 3 and (unit := next(waiting, None)) is not None:
            active.append(unit)
        if len(active) == 3:
            (a, _), (b, _), (c, _) = active
            step = (c - b, a - c, b - a)
            if not any(step):
                step = (1.0, -1.0, 0.0)
        elif len(active) == 2 and active[0][0] == active[1][0]:
            step = (1.0, -1.0)
        else:
            return
        up = min((1 - u[1]) / s if s > 0 else -u[1] / s for u, s in zip(active, step) if s)
        down = min(u[1] / s if s > 0 else (u[1] - 1) / s for u, s in zip(active, step) if s)
        move = up if rng.random() * (up + down) < down else -down
        for unit, s in zip(active, step):
            unit[1] += move * s
            if unit[1] < NEAR:
                unit[1] = 0.0
            elif unit[1] > 1 - NEAR:
                unit[1] = 1.0
        active = [u for u in active if 0.0 < u[1] < 1.0]


def land(units: list[list[float]], wanted: float) -> None:
    """Decide the last (at most two) fractional units so that the tokens come closest to ``wanted``.

    What is still missing is made up by turning, one by one, the decided unit that brings
    the tokens closest; this ends when none does.
    """
    left = [u for u in units if 0.0 < u[1] < 1.0]
    gap = wanted - sum(u[0] for u in units if u[1] == 1.0)
    ways = range(1 << len(left))
    best = min(ways, key=lambda w: abs(gap - sum(u[0] for i, u in enumerate(left) if w >> i & 1)))
    for i, unit in enumerate(left):
        unit[1] = float(best >> i & 1)
        gap -= unit[0] * unit[1]
    while units:
        unit = min(units, key=lambda u: abs(gap - (u[0] if u[1] == 0.0 else -u[0])))
        change = unit[0] if unit[1] == 0.0 else -unit[0]
        if abs(gap - change) >= abs(gap):
            break
        unit[1], gap = 1.0 - unit[1], gap - change


def _flyer(size: str, p: str, order: str, level: int, last: bool):
    def fly(frame: pd.DataFrame) -> pd.DataFrame:
        # large documents first, so that the last, undecided ones are small
        frame = frame.sort_values([size, order], ascending=[False, True], kind="stable").reset_index(drop=True)
        units = [list(u) for u in zip(frame[size].astype(float), frame[p].astype(float))]
        before = [u[1] for u in units]
        free = [0.0 < q < 1.0 for q in before]
        flight(units, random.Random(f"{level} {frame[order].min()}"))
        if last:
            land([u for u, f in zip(units, free) if f], sum(u[0] * q for u, q, f in zip(units, before, free) if f))
        frame[p] = [u[1] for u in units]
        return frame.drop(columns=["_n", "_block"])

    return fly


def cube_sample(rows: DataFrame, stratum: str, size: str, p: str, order: str, block: int = BLOCK) -> DataFrame:
    """Turn the probabilities ``p`` into 0 or 1, keeping each stratum's sums of p and of size * p.

    ``order`` is a hash of the row; rows are dealt to blocks and ordered by it.  The
    number of levels is the logarithm of the largest stratum to the base block / 2.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    undecided, decided, level = rows, [], 0
    while True:
        counts = undecided.groupBy(stratum).agg(F.ceil(F.count("*") / block).alias("_n"))
        counts = stored(counts, "strata")
        largest = counts.agg(F.max("_n")).first()[0]
        if largest is None:  # nothing left
            break
        last = largest <= 1
        dealt = undecided.join(counts.withColumnRenamed(stratum, "_stratum"), F.col(stratum).eqNullSafe(F.col("_stratum"))).drop("_stratum")
        dealt = dealt.withColumn("_block", F.pmod(F.xxhash64(order, F.lit(level)), F.col("_n")))
        moved = stored(dealt.groupBy(stratum, "_block").applyInPandas(_flyer(size, p, order, level, last), schema), "flight")
        whole = F.col(p).isin(0.0, 1.0)
        decided.append(moved.where(whole))
        undecided, level = moved.where(~whole), level + 1
        if last:
            break
    out = decided[0] if decided else rows
    for part in decided[1:]:
        out = out.union(part)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, row_hash, size, source, source_size, target, copies: how often the mix takes each row.

    Null texts and texts without words have size 0; a null source is a source of its
    own; repeated rows are separate rows.  No document is taken more than twice.
    """
    narrow = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            sizes(docs, text_col).alias("size"), F.xxhash64(id_col, text_col).alias("row_hash"),
        ),
        "sizes",
    )
    targets = stored(source_targets(narrow), "targets").withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = narrow.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("rate", F.least(rate, F.lit(2.0))).withColumn("certain", F.floor("rate")).withColumn("p", F.col("rate") - F.col("certain"))
    sampled = cube_sample(rows.drop("rate"), "source", "size", "p", "row_hash")
    return sampled.withColumn("copies", (F.col("certain") + F.col("p")).cast("int")).drop("certain", "p")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, with their own columns, whatever their names.

    Null and wordless texts have size 0 and are taken as their source's rate says; a null
    source is a source; rows equal in id and text share their copies between them.
    """
    taken = mix(docs, id_col, text_col, source_col)
    # rows that are equal in id and text share their copies
    shared = stored(taken.groupBy("row_hash").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")), "copies")
    keyed = enclosed(docs, id=id_col, text=text_col).select("id", F.xxhash64("id", "text").alias("key"), "own")
    joined = keyed.join(shared.withColumnRenamed("row_hash", "key"), "key")
    single = joined.where(F.col("_copies") % F.col("_rows") == 0).withColumn("_take", F.expr("_copies div _rows"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    several = joined.where(F.col("_copies") % F.col("_rows") != 0).withColumn(
        "_take", F.expr("_copies div _rows") + F.when(turn <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    )
    rows = single.unionByName(several).where("_take > 0")
    return rows.withColumn("_take", F.explode(F.sequence(F.lit(1), F.col("_take").cast("int")))).select("own.*")


def op4_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )

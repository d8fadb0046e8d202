"""Exact order statistics of huge groups without sorting them in one task.

``row_number`` over a group moves the whole group to one task.  Cutting a group
at its k-th row needs only the k-th row itself, found by narrowing: count rows
per coarse bucket (a day, a hash prefix), keep the bucket that holds row k, count
finer buckets inside it, and so on.  Counts are combined map-side, and every pass
reads only the group and order columns.  The last bucket is small by construction
and is the only thing that gets ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

SMALL_BUCKET = 200_000
MAX_TARGETS = 10_000


def hash_key(*parts: Column) -> Column:
    """md5 over the parts: a seeded order that is the same on any partitioning."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def time_levels(ts: Column, tie: Column) -> dict[str, Column]:
    """Bucket columns, coarse to fine, for the order (timestamp, tie hash)."""
    return {
        "_day": F.to_date(ts),
        "_minute": F.hour(ts) * 60 + F.minute(ts),
        "_ts": ts,
        "_prefix": F.substring(tie, 1, 4),
        "_tie": tie,
    }


def hash_levels(tie: Column) -> dict[str, Column]:
    return {"_prefix": F.substring(tie, 1, 4), "_tie": tie}


def _local(df: DataFrame) -> tuple[list, T.StructType]:
    """Collect a frame that has one row per target; more than MAX_TARGETS is refused."""
    rows = df.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} cut points; the group column is not a class")
    return rows, df.schema


def nth_rows(
    df: DataFrame,
    groups: Sequence[str],
    levels: dict[str, Column],
    targets: DataFrame,
    small_bucket: int = SMALL_BUCKET,
) -> DataFrame:
    """Level values of the k-th row per target.

    ``levels`` define an ascending order, coarse to fine; the last one must be
    unique within the others.  ``targets`` is ``(*groups, target, k)``, k from 1,
    and has few rows (groups are classes).  Returns ``(*groups, target, *levels)``.
    """
    spark, names = df.sparkSession, list(levels)
    if not groups:
        one = {"_all": F.lit(0)}
        return nth_rows(
            df.withColumns(one), ["_all"], levels, targets.withColumns(one), small_bucket
        ).drop("_all")
    groups = list(groups)
    rows = df.select(*groups, *[c.alias(n) for n, c in levels.items()])
    found, schema = _local(targets.select(*groups, "target", F.col("k").cast("bigint").alias("_left")))
    known: list[str] = []
    for place, level in enumerate(names):
        state = spark.createDataFrame(found, schema)
        at = [*groups, *known]
        inside = rows.join(F.broadcast(state.select(*at).distinct()), at, "left_semi")
        counts = inside.groupBy(*at, level).agg(F.count(F.lit(1)).alias("_n"))
        counts = counts.withColumn("_upto", F.sum("_n").over(W.partitionBy(*at).orderBy(level)))
        joined = counts.join(F.broadcast(state), at)
        hit = joined.filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
        known.append(level)
        picked = hit.select(
            *groups, "target", *known, (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), "_n"
        )
        collected, picked_schema = _local(picked)
        largest = max((r["_n"] for r in collected), default=0)
        found = [r[:-1] for r in collected]
        schema = T.StructType(picked_schema.fields[:-1])
        finer = names[place + 1 :]
        if not finer:
            return spark.createDataFrame(found, schema).drop("_left")
        if largest <= small_bucket:
            state = spark.createDataFrame(found, schema)
            at = [*groups, *known]
            bucket = rows.join(F.broadcast(state.select(*at).distinct()), at, "left_semi")
            ranked = bucket.withColumn(
                "_rank", F.row_number().over(W.partitionBy(*at).orderBy(*finer))
            )
            cut = ranked.join(F.broadcast(state), at).filter(F.col("_rank") == F.col("_left"))
            final, final_schema = _local(cut.select(*groups, "target", *names))
            return spark.createDataFrame(final, final_schema)
    raise AssertionError("unreachable")

"""Exact quantiles of huge groups by narrowing value ranges.

All ranks asked of a group share its value range at first.  A round counts the values of
each open range in ``BINS`` equal bins, with the least and the greatest value of every
bin; a rank goes on in the bin that holds it, whose range is these two values, until
they are one.  Counts combine map-side, so no group is in one task; the state is a table
with one row per group and open range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.storagelevel import StorageLevel

from inkwell.session import written

BINS = 1024


def group_quantiles(df: DataFrame, by: Sequence[str], col: str, points: Sequence[float], out: str = "quantiles") -> DataFrame:
    """``(*by, out)``: the quantiles of a column per group, interpolated between the two ranks around them.

    Rows with a null in any column take no part, nor do NaNs.  Infinite values count.
    """
    by = list(by)
    x = F.col(col).cast("double")
    rows = df.select(*by, x.alias("_x")).dropna().filter(~F.isnan("_x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ranges = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        place = lambda q: (F.col("_size") - 1) * F.lit(float(q))
        ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in points])))
        state = written(ranges.select(*by, "_size", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.explode(ranks).alias("_rank")), "ranks")
        while not state.filter("_lo < _hi").isEmpty():
            state = written(_narrowed(rows, by, state), "ranks")
    finally:
        rows.unpersist()
    values = state.groupBy(*by, "_size").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_at"))

    def between(q: float):
        low, high = F.floor(place(q)), F.ceil(place(q))
        below, above = F.element_at("_at", low), F.element_at("_at", high)
        return F.when((low == high) | (below == above), below).otherwise((high - place(q)) * below + (place(q) - low) * above)

    return values.select(*by, F.array(*[between(q) for q in points]).alias(out))


def _narrowed(rows: DataFrame, by: list[str], state: DataFrame) -> DataFrame:
    """The state after one round: closed ranks as they are, open ones in the bin that holds them."""
    names = state.columns
    opened = state.filter("_lo < _hi")
    ranges = opened.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], "_lo", "_hi").distinct()
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & (F.col(c) == F.col(f"_g{k}"))
    share = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS
    spread = F.least(F.floor(F.when(F.isnan(share), 0.0).otherwise(share)), F.lit(BINS - 1))
    endless = F.col("_hi") - F.col("_lo") == F.lit(float("inf"))
    place = (
        F.when(F.col("_x") == F.lit(float("-inf")), -1).when(F.col("_x") == F.lit(float("inf")), BINS)
        .when(endless, F.when(F.col("_x") < 0, 0).otherwise(1)).otherwise(spread)
    )
    counted = (
        rows.join(ranges, same & F.col("_x").between(F.col("_lo"), F.col("_hi")))
        .groupBy(*by, "_lo", "_hi", place.alias("_bin"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    )
    upto = F.sum("_n").over(W.partitionBy(*by, "_lo", "_hi").orderBy("_bin"))  # at most BINS + 2 rows
    bins = counted.withColumn("_upto", upto)
    joined = opened.join(bins, [*by, "_lo", "_hi"])
    inside = F.col("_rank") - F.col("_below")
    hit = joined.filter((inside >= F.col("_upto") - F.col("_n")) & (inside < F.col("_upto")))
    moved = hit.select(
        *by, "_size", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"),
        (F.col("_below") + F.col("_upto") - F.col("_n")).alias("_below"), "_rank",
    )
    return state.filter("_lo = _hi").select(*names).unionByName(moved.select(*names))

"""Leakage-safe splits: temporal, stratified, rolling folds.

Every split is a comparison of a row with a few cut points, so wide rows are
never shuffled or sorted; see :mod:`inkwell.operators.ranking`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from inkwell.operators.ranking import hash_key, hash_levels, nth_rows, time_levels


def _with_cuts(df: DataFrame, cuts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Attach the cut points of its group to each row (a few rows, broadcast)."""
    if groups:
        return df.join(F.broadcast(cuts), list(groups), "left")
    one = {"_all": F.lit(0)}
    return df.withColumns(one).join(F.broadcast(cuts.withColumns(one)), "_all", "left").drop("_all")


def temporal_split(df: DataFrame, ts_col: str, key_col: str, frac: float = 0.8) -> DataFrame:
    """Earliest ``int(frac * n)`` dated rows train, the rest test; undated rows train."""
    tie = hash_key(F.col(key_col))
    dated = df.filter(F.col(ts_col).isNotNull())
    n = dated.count()
    k = int(frac * n)
    if k == 0:
        return df.withColumn("split", F.when(F.col(ts_col).isNull(), "train").otherwise("test"))
    targets = df.sparkSession.createDataFrame([(0, k)], "target int, k bigint")
    cut = nth_rows(dated, [], time_levels(F.col(ts_col), tie), targets).select(
        F.col("_ts").alias("_cut_ts"), F.col("_tie").alias("_cut_tie")
    )
    late = (F.col(ts_col) > F.col("_cut_ts")) | (
        (F.col(ts_col) == F.col("_cut_ts")) & (tie > F.col("_cut_tie"))
    )
    return (
        _with_cuts(df, cut, [])
        .withColumn("split", F.when(late, "test").otherwise("train"))
        .drop("_cut_ts", "_cut_tie")
    )


def time_stratified_split(
    df: DataFrame, group_col: str, ts_col: str, key_col: str, frac: float = 0.2
) -> DataFrame:
    """Per group the newest ``max(1, round(n * frac))`` dated rows test; undated rows train.

    ``round`` is half-even.
    """
    tie = hash_key(F.col(key_col))
    dated = df.filter(F.col(ts_col).isNotNull() & F.col(group_col).isNotNull())
    targets = dated.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n")).select(
        group_col,
        F.lit(0).alias("target"),
        (F.col("_n") - F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(frac))).cast("bigint") + 1).alias("k"),
    )
    cuts = nth_rows(dated, [group_col], time_levels(F.col(ts_col), tie), targets).select(
        group_col, F.col("_ts").alias("_cut_ts"), F.col("_tie").alias("_cut_tie")
    )
    newest = (F.col(ts_col) > F.col("_cut_ts")) | (
        (F.col(ts_col) == F.col("_cut_ts")) & (tie >= F.col("_cut_tie"))
    )
    return (
        _with_cuts(df, cuts, [group_col])
        .withColumn("split", F.when(newest, "test").otherwise("train"))
        .drop("_cut_ts", "_cut_tie")
    )


def rolling_slices(df: DataFrame, ts_col: str, key_col: str, k: int = 5) -> DataFrame:
    """Slice id 0..k in time order; slices 1..k hold ``n // (k + 1)`` rows each.

    The remainder belongs to slice 0, which only ever trains.  Undated rows get
    slice 0 as well, so they never serve as validation rows.
    """
    tie = hash_key(F.col(key_col))
    dated = df.filter(F.col(ts_col).isNotNull())
    n = dated.count()
    size = n // (k + 1)
    if size == 0:
        raise ValueError(f"{n} dated rows are too few for {k} folds")
    starts = [(i, n - (k - i + 1) * size + 1) for i in range(1, k + 1)]
    targets = df.sparkSession.createDataFrame(starts, "target int, k bigint")
    cuts = nth_rows(dated, [], time_levels(F.col(ts_col), tie), targets)
    packed = cuts.agg(F.collect_list(F.struct("_ts", "_tie")).alias("_cuts"))
    reached = F.filter(
        "_cuts",
        lambda c: (F.col(ts_col) > c["_ts"]) | ((F.col(ts_col) == c["_ts"]) & (tie >= c["_tie"])),
    )
    return (
        _with_cuts(df, packed, [])
        .withColumn("slice", F.when(F.col(ts_col).isNull(), 0).otherwise(F.size(reached)))
        .drop("_cuts")
    )


def rolling_folds(df: DataFrame, ts_col: str, key_col: str, k: int = 5) -> DataFrame:
    """Rows repeated as ``(fold, role)``: fold i trains on slices before i + 1, validates on it."""
    sliced = rolling_slices(df, ts_col, key_col, k)
    first = F.greatest(F.col("slice") - 1, F.lit(0))
    return (
        sliced.withColumn("fold", F.explode(F.sequence(first, F.lit(k - 1))))
        .withColumn("role", F.when(F.col("slice") == F.col("fold") + 1, "validate").otherwise("train"))
        .drop("slice")
    )


def stratified_split(
    df: DataFrame, class_col: str, key_col: str, frac: float = 0.2, seed: int = 0
) -> DataFrame:
    """Class-proportional random split: the lowest ``round(n * frac)`` hashes of a class test."""
    tie = hash_key(F.col(key_col), F.lit(seed))
    known = df.filter(F.col(class_col).isNotNull())
    targets = known.groupBy(class_col).agg(F.count(F.lit(1)).alias("_n")).select(
        class_col, F.lit(0).alias("target"), F.bround(F.col("_n") * F.lit(frac)).cast("bigint").alias("k")
    ).filter(F.col("k") > 0)
    cuts = nth_rows(known, [class_col], hash_levels(tie), targets).select(
        class_col, F.col("_tie").alias("_cut_tie")
    )
    return (
        _with_cuts(df, cuts, [class_col])
        .withColumn("split", F.when(tie <= F.col("_cut_tie"), "test").otherwise("train"))
        .drop("_cut_tie")
    )


def repeated_folds(
    df: DataFrame, class_col: str, key_col: str, k: int = 5, repeats: int = 3, seed: int = 0
) -> DataFrame:
    """Columns ``fold_0 .. fold_{repeats-1}``: stratified fold of the row in each repeat."""
    for repeat in range(repeats):
        df = _stratified_fold(df, class_col, key_col, k, seed + repeat, f"fold_{repeat}")
    return df


def _stratified_fold(df: DataFrame, class_col: str, key_col: str, k: int, seed: int, name: str) -> DataFrame:
    tie = hash_key(F.col(key_col), F.lit(seed))
    known = df.filter(F.col(class_col).isNotNull())
    counts = known.groupBy(class_col).agg(F.count(F.lit(1)).alias("_n"))
    fold = F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("target")
    targets = counts.select(class_col, "_n", fold).select(
        class_col, "target", (F.ceil(F.col("target") * F.col("_n") / F.lit(k)) + 1).alias("k")
    )
    cuts = nth_rows(known, [class_col], hash_levels(tie), targets)
    packed = cuts.groupBy(class_col).agg(F.array_sort(F.collect_list("_tie")).alias("_cuts"))
    return (
        _with_cuts(df, packed, [class_col])
        .withColumn(name, F.coalesce(F.size(F.filter("_cuts", lambda c: tie >= c)), F.lit(0)))
        .drop("_cuts")
    )


def split_guard(split: DataFrame, positive, class_col: str, max_gap: float = 0.2) -> DataFrame:
    """One row: positive share of train and test, and whether the split should be redone."""
    is_positive = (F.col(class_col) == F.lit(positive)).cast("int")
    return split.agg(
        F.avg(F.when(F.col("split") == "train", is_positive)).alias("train_share"),
        F.avg(F.when(F.col("split") == "test", is_positive)).alias("test_share"),
    ).withColumn("fall_back", F.abs(F.col("train_share") - F.col("test_share")) > F.lit(max_gap))


def guarded_split(
    df: DataFrame, class_col: str, ts_col: str, key_col: str, positive, max_gap: float = 0.2,
    frac: float = 0.2, seed: int = 0,
) -> DataFrame:
    """Temporal split, replaced by a stratified one when class shares drift apart."""
    split = temporal_split(df, ts_col, key_col, 1 - frac)
    verdict = split_guard(split, positive, class_col, max_gap).first()
    return stratified_split(df, class_col, key_col, frac, seed) if verdict["fall_back"] else split


def split_summary(split: DataFrame, class_col: str, ts_col: str) -> DataFrame:
    """Rows, class share and date range per (split, class)."""
    per_class = split.groupBy("split", class_col).agg(
        F.count(F.lit(1)).alias("rows"), F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts")
    )
    totals = per_class.groupBy("split").agg(F.sum("rows").alias("split_rows"))
    return per_class.join(totals, "split").withColumn("share", F.col("rows") / F.col("split_rows"))


def split_ranges(split: DataFrame, group_col: str, ts_col: str) -> DataFrame:
    """Train and test date range side by side per group, in one pass."""
    ts = {s: F.when(F.col("split") == s, F.col(ts_col)) for s in ("train", "test")}
    return split.filter(F.col(group_col).isNotNull()).groupBy(group_col).agg(
        *[agg(ts[s]).alias(f"{s}_{name}") for s in ts for name, agg in (("min", F.min), ("max", F.max))]
    )


def word_dropout_rows(
    train: DataFrame, text_col: str, key_col: str, rate: float = 0.1, seed: int = 0
) -> DataFrame:
    """Training rows plus one word-dropped copy of each, marked ``augmented``."""
    from inkwell.functions.text import word_dropout

    copies = train.withColumn(text_col, word_dropout(F.col(text_col), F.col(key_col), rate, seed))
    return train.withColumn("augmented", F.lit(0)).unionByName(copies.withColumn("augmented", F.lit(1)))

"""Profiles and group comparisons as single-pass aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from inkwell.functions.text import is_missing
from inkwell.functions.urls import page_kind
from inkwell.operators.quantiles import group_quantiles

# Weekday order of posting profiles.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def with_total(counts: DataFrame, by: Sequence[str], n: str, out: str) -> DataFrame:
    """Attach the sum of ``n`` per group (or overall) by joining an aggregate.

    A window would pull every value of a group into one task; a column can have
    as many values as the table has rows.
    """
    if by:
        return counts.join(counts.groupBy(*by).agg(F.sum(n).alias(out)), list(by))
    one = {"_all": F.lit(0)}
    total = counts.agg(F.sum(n).alias(out)).withColumns(one)  # a single row
    return counts.withColumns(one).join(F.broadcast(total), "_all").drop("_all")


def value_share(df: DataFrame, col: str, by: Sequence[str] = (), scale: float = 100.0) -> DataFrame:
    """``(*by, col, n, share)``; NULL values are left out of numerator and denominator."""
    counts = _present(df, [*by, col]).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    return (
        with_total(counts, by, "n", "_total")
        .withColumn("share", F.col("n") * F.lit(scale) / F.col("_total"))
        .drop("_total")
    )


def class_balance(df: DataFrame, col: str) -> DataFrame:
    return value_share(df, col, scale=1.0)


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence[str], share_of: str | None = None) -> DataFrame:
    """Count matrix with zeros kept; optionally the share of one column in its row."""
    wide = _present(df, [row, col]).groupBy(row).pivot(col, list(values)).count().na.fill(0)
    if share_of is not None:
        total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
        wide = wide.withColumn(f"{share_of}_share", F.col(share_of) / F.nullif(total, F.lit(0)))
    return wide


def align_groups(df: DataFrame, key: str, group: str, groups: Sequence[str]) -> DataFrame:
    """Union of keys over the groups with absent counts as 0."""
    return pivot_counts(df.filter(F.col(group).isin(*groups)), key, group, groups)


def grouped_summary(df: DataFrame, by: Sequence[str], aggs: dict[str, Column], digits: int | None = None) -> DataFrame:
    named = [(F.round(c, digits) if digits is not None else c).alias(n) for n, c in aggs.items()]
    return _present(df, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *named)


def describe_by(df: DataFrame, by: Sequence[str], col: str, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per group.

    Exact quartiles narrow value ranges (:mod:`inkwell.operators.quantiles`); ``exact=False``
    estimates them in the same pass as the rest.
    """
    rows = _present(df, [*by, col])
    points = (0.25, 0.5, 0.75)
    named = [F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max")]
    if exact:
        out = rows.groupBy(*by).agg(*named).join(group_quantiles(rows, by, col, points, "_q"), list(by))
    else:
        out = rows.groupBy(*by).agg(*named, F.percentile_approx(col, F.array(*map(F.lit, points)), 100_000).alias("_q"))
    return out.select(
        *by, "count", "mean", "std", "min", F.col("_q")[0].alias("p25"), F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max"
    )


def time_coverage(df: DataFrame, by: str, ts_col: str) -> DataFrame:
    return _present(df, [by]).groupBy(by).agg(
        F.min(ts_col).alias("first_ts"), F.max(ts_col).alias("last_ts"),
        F.count(ts_col).alias("dated"), F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(ts_col).isNull()).alias("undated"),
    )


def na_profile(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """``(by, column, missing, rows)``, plus the row count lacking any (column ``<any>``)."""
    tests = {c: is_missing(F.col(c).cast("string")) for c in cols}
    lacks_any = F.lit(False)
    for test in tests.values():
        lacks_any = lacks_any | test
    tests["<any>"] = lacks_any
    one_pass = _present(df, [by]).groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(t).alias(c) for c, t in tests.items()]
    )
    return one_pass.unpivot([by, "rows"], list(tests), "column", "missing")


def na_examples(df: DataFrame, cols: Sequence[str], key_col: str, n: int = 5) -> DataFrame:
    """The ``n`` lowest keys lacking each column."""
    lacking = F.array_compact(
        F.array(*[F.when(is_missing(F.col(c).cast("string")), F.lit(c)) for c in cols])
    )
    rows = df.select(key_col, F.explode(lacking).alias("column"))
    rank = F.row_number().over(W.partitionBy("column").orderBy(key_col))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def flag_rates(df: DataFrame, by: str, flags: Sequence[str], scale: float = 100.0) -> DataFrame:
    """``(by, flag, rate)``."""
    rates = _present(df, [by]).groupBy(by).agg(
        *[(F.avg(F.col(f).cast("double")) * F.lit(scale)).alias(f) for f in flags]
    )
    return rates.unpivot([by], list(flags), "flag", "rate")


def effect_size(df: DataFrame, by: str, a, b, features: Sequence[str]) -> DataFrame:
    """Group means, absolute difference, pooled std (ddof 1) and Cohen's d per feature.

    One aggregate yields a handful of numbers per group; everything after it is
    arithmetic on ``len(features)`` rows.  Zero variance gives NULL.
    """
    in_a, in_b = F.col(by) == F.lit(a), F.col(by) == F.lit(b)
    aggs = []
    for f in features:
        value = F.col(f).cast("double")
        for side, inside in (("a", in_a), ("b", in_b)):
            picked = F.when(inside, value)
            aggs += [
                F.count(picked).alias(f"n_{side}|{f}"), F.avg(picked).alias(f"m_{side}|{f}"),
                F.var_samp(picked).alias(f"v_{side}|{f}"),
            ]
    stats = df.filter(in_a | in_b).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                *[F.col(f"`{s}_{g}|{f}`").alias(f"{s}_{g}") for g in "ab" for s in "nmv"],
            )
            for f in features
        ]
    )
    pooled = F.sqrt(
        ((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b"))
        / F.nullif(F.col("n_a") + F.col("n_b") - 2, F.lit(0))
    )
    diff = F.col("m_a") - F.col("m_b")
    return stats.select(F.inline(rows)).select(
        "feature", F.col("m_a").alias("mean_a"), F.col("m_b").alias("mean_b"),
        F.abs(diff).alias("abs_diff"), pooled.alias("pooled_std"),
        (diff / F.nullif(pooled, F.lit(0.0))).alias("cohens_d"),
    )


def select_features(effects: DataFrame, min_d: float = 0.35, n: int | None = None) -> DataFrame:
    strong = effects.filter(F.abs("cohens_d") > min_d)
    return strong if n is None else top_n(strong, F.abs(F.col("cohens_d")), n, "feature")


def n_distinct(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column; texts are counted by their 128-bit digests, so no text is shuffled."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in cols])
    digest = {f.name: F.unhex(F.md5(F.col(f.name))) for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.agg(*[F.count_distinct(digest.get(c, F.col(c))).alias(c) for c in cols])


def share_divergence(df: DataFrame, col: str, by: str, a: str, b: str, k: int | None = None) -> DataFrame:
    """Within-group share per value, the absolute gap, and which side lacks the value."""
    shares = value_share(df.filter(F.col(by).isin(a, b)), col, [by])
    side = lambda g, c: F.coalesce(F.max(F.when(F.col(by) == g, F.col(c))), F.lit(0))
    wide = shares.groupBy(col).agg(side(a, "share").alias("share_a"), side(b, "share").alias("share_b"))
    wide = wide.withColumns(
        {
            "abs_diff": F.abs(F.col("share_a") - F.col("share_b")),
            "only_in": F.when(F.col("share_b") == 0, a).when(F.col("share_a") == 0, b),
        }
    )
    return wide if k is None else top_n(wide, F.col("abs_diff"), k, col)


def overlap_matrix(df: DataFrame, a: str, b: str, exclude: Sequence = ()) -> DataFrame:
    """Percent of all rows in each (a, b) cell, zeros kept.

    NULL and ``exclude`` values (an outlier mark, say) have no cells but their
    rows stay in the denominator.  The grid is the product of the distinct values of
    both sides, which is what is asked for; only counts are joined to it.
    """
    known = _present(df, [a, b])
    if exclude:
        known = known.filter(~F.col(a).isin(*exclude) & ~F.col(b).isin(*exclude))
    counts = known.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select(a).distinct().crossJoin(counts.select(b).distinct())
    total = df.agg(F.count(F.lit(1)).alias("_total"))  # one row
    return (
        grid.join(counts, [a, b], "left").crossJoin(F.broadcast(total))
        .select(a, b, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) * 100.0 / F.col("_total")).alias("percent"))
    )


def histogram(df: DataFrame, col: str, width: float, by: str) -> DataFrame:
    """Fixed-width bins with density ``n / (N * width)`` and the group median."""
    rows = _present(df, [by, col])
    counts = rows.groupBy(by, F.floor(F.col(col) / F.lit(width)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(by))
    medians = group_quantiles(rows, [by], col, [0.5])
    return counts.withColumn("density", F.col("n") / (total * F.lit(width))).join(medians, by).select(
        by, (F.col("bin") * F.lit(width)).alias("bin_start"), "n", "density", F.col("quantiles")[0].alias("median")
    )


def density_curve(df: DataFrame, col: str, by: str, lo: float, hi: float, points: int = 50) -> DataFrame:
    """Gaussian kernel density per group on an even grid, Scott bandwidth.

    Rows shrink to distinct values first; each value then adds its kernel to a
    grid of fixed length, and sums combine map-side.
    """
    values = _present(df, [by, col]).groupBy(by, F.col(col).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("w"))
    mass = F.sum("w")
    mean = F.sum(F.col("w") * F.col("x")) / mass
    spread = (F.sum(F.col("w") * F.col("x") * F.col("x")) - mass * mean * mean) / (mass - 1)
    bands = values.groupBy(by).agg(mass.alias("total"), (F.sqrt(spread) * F.pow(mass, F.lit(-0.2))).alias("h"))
    step = (hi - lo) / (points - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(i.alias("i"), (F.lit(lo) + i * F.lit(step)).alias("g")))
    z = (F.col("g") - F.col("x")) / F.col("h")
    return (
        values.join(bands.filter("h > 0"), by)
        .select(by, "x", "w", "h", "total", F.inline(grid))
        .groupBy(by, "i")
        .agg((F.sum(F.col("w") * F.exp(-0.5 * z * z) / (F.col("total") * F.col("h") * F.sqrt(2 * F.pi())))).alias("density"))
        .select(by, (F.lit(lo) + F.col("i") * F.lit(step)).alias("grid"), "density")
    )


def posting_profile(df: DataFrame, by: str, ts_col: str) -> DataFrame:
    """Percent of articles per hour and per weekday within each group.

    Both profiles come from one aggregate over (group, hour, weekday).
    """
    cells = _present(df, [by, ts_col]).groupBy(
        by, F.hour(ts_col).alias("_hour"), F.date_format(ts_col, "EEEE").alias("_day")
    ).agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("_day")).cast("int") - 1
    parts = F.array(
        F.struct(F.lit("hour").alias("part"), F.col("_hour").cast("string").alias("value"), F.col("_hour").alias("position")),
        F.struct(F.lit("weekday").alias("part"), F.col("_day").alias("value"), place.alias("position")),
    )
    tall = cells.select(by, "n", F.inline(parts)).groupBy(by, "part", "value", "position").agg(F.sum("n").alias("n"))
    return tall.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(by, "part")))


def token_length_stats(df: DataFrame, counts: Column, limit: int = 64) -> DataFrame:
    n = counts.cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(n).alias("mean_tokens"), F.max(n).alias("max_tokens"),
        F.count_if(n >= limit).alias("at_limit"),
    )


def gap_report(df: DataFrame, key_col: str, author_col: str, ts_col: str, kind: Column | None = None) -> DataFrame:
    """Rows lacking author or date, by page kind, and distinct keys to refill: one row."""
    no_author = is_missing(F.col(author_col))
    no_ts = is_missing(F.col(ts_col).cast("string"))
    gap = no_author | no_ts
    live = (page_kind(F.col(key_col)) if kind is None else kind) == "live"
    return df.agg(
        F.count_if(gap).alias("rows_with_gap"), F.count_if(gap & live).alias("live_with_gap"),
        F.count_if(gap & ~live).alias("other_with_gap"), F.count_if(no_author).alias("missing_author"),
        F.count_if(no_ts).alias("missing_ts"),
        F.count_distinct(F.when(gap, F.col(key_col))).alias("keys_to_refill"),
    )


def missing_by(df: DataFrame, col: str, by: str) -> DataFrame:
    return df.filter(is_missing(F.col(col))).groupBy(by).agg(F.count(F.lit(1)).alias("missing"))


def url_pattern_counts(df: DataFrame, url_col: str, patterns: dict[str, str]) -> DataFrame:
    """``(pattern, n)`` for a list of regular expressions, in one pass."""
    counts = df.agg(*[F.count_if(F.col(url_col).rlike(p)).alias(n) for n, p in patterns.items()])
    return counts.withColumn("_one", F.lit(1)).unpivot(["_one"], list(patterns), "pattern", "n").drop("_one")


def top_n(df: DataFrame, metric: Column, n: int, key: str) -> DataFrame:
    """The ``n`` largest by metric, ties by key (a top-k report: tasks keep n rows each)."""
    return df.orderBy(metric.desc(), F.col(key).asc()).limit(n)


def top_k_per_group(df: DataFrame, group: str, value: str, k: int = 8) -> DataFrame:
    """The ``k`` most frequent values per group, ranked on the aggregated counts."""
    counts = _present(df, [group, value]).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.col("n").desc(), F.col(value).asc()))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def sample_rows(df: DataFrame, key_col: str, n: int, seed: int, by: str) -> DataFrame:
    """Seeded spot check: the ``n`` lowest key hashes per stratum.

    Catalyst limits each group inside every task before the shuffle, so a hot
    stratum sends ``n`` rows per task.
    """
    from inkwell.operators.ranking import hash_key

    order = W.partitionBy(by).orderBy(hash_key(F.col(key_col), F.lit(seed)))
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")

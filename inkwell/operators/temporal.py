"""Event windows, calendars, monthly mixes, trends and smoothing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from inkwell.functions.dates import month_of
from inkwell.operators.profile import pivot_counts, top_k_per_group, value_share


def _event_days(events: DataFrame, days: int) -> DataFrame:
    """One row per (event, calendar day its window touches): an equi-join key."""
    span = F.expr(f"INTERVAL '{days}' DAY")
    return events.select(
        "event", (F.col("event_ts") - span).alias("_from"), (F.col("event_ts") + span).alias("_to")
    ).withColumn("_day", F.explode(F.sequence(F.to_date("_from"), F.to_date("_to"))))


def in_event_window(df: DataFrame, events: DataFrame, ts_col: str, days: int = 14) -> DataFrame:
    """Rows inside ``event_ts ± days`` (inclusive), once per event they fall into.

    ``events``: ``(event, event_ts)``.  The interval join is an equi-join on the
    day with an exact residual test, so it hashes instead of comparing all pairs;
    Catalyst broadcasts the events where their size is known to be small.
    """
    return (
        df.withColumn("_day", F.to_date(ts_col))
        .join(_event_days(events, days), "_day")
        .filter(F.col(ts_col).between(F.col("_from"), F.col("_to")))
        .drop("_day", "_from", "_to")
    )


def event_mask(df: DataFrame, events: DataFrame, ts_col: str, days: int = 14) -> DataFrame:
    """Flag ``in_any_event``; the baseline is its complement (undated rows included)."""
    windows = _event_days(events, days).groupBy("_day").agg(F.collect_list(F.struct("_from", "_to")).alias("_windows"))
    inside = F.exists("_windows", lambda w: F.col(ts_col).between(w["_from"], w["_to"]))
    return (
        df.withColumn("_day", F.to_date(ts_col))
        .join(windows, "_day", "left")
        .withColumn("in_any_event", F.coalesce(inside, F.lit(False)))
        .drop("_day", "_windows")
    )


def event_shift(
    df: DataFrame, events: DataFrame, ts_col: str, by: str, metrics: Sequence[str], days: int = 14
) -> DataFrame:
    """Means of metrics inside each event window against all other rows, per group.

    Sums and counts are taken once over the whole table and once over the rows
    inside windows; the baseline is their difference, so no row is repeated per
    event.
    """
    dated = df.filter(F.col(ts_col).isNotNull() & F.col(by).isNotNull())
    def sums(prefix: str) -> list[Column]:
        return [F.count(F.lit(1)).alias(f"{prefix}n")] + [
            agg(F.col(m).cast("double")).alias(f"{prefix}{kind}_{m}")
            for m in metrics for kind, agg in (("sum", F.sum), ("cnt", F.count))
        ]

    overall = dated.groupBy(by).agg(*sums("all_"))
    inside = in_event_window(dated, events, ts_col, days).groupBy("event", by).agg(*sums("in_"))
    joined = inside.join(overall, by)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                (F.col(f"in_sum_{m}") / F.nullif(F.col(f"in_cnt_{m}"), F.lit(0))).alias("window_mean"),
                (
                    (F.col(f"all_sum_{m}") - F.col(f"in_sum_{m}"))
                    / F.nullif(F.col(f"all_cnt_{m}") - F.col(f"in_cnt_{m}"), F.lit(0))
                ).alias("baseline_mean"),
            )
            for m in metrics
        ]
    )
    return joined.select(
        "event", by, F.col("in_n").alias("window_n"), (F.col("all_n") - F.col("in_n")).alias("baseline_n"), F.inline(rows)
    )


def event_topic_shift(
    df: DataFrame, events: DataFrame, ts_col: str, by: str, topic: str, days: int = 14, k: int = 8
) -> DataFrame:
    """Topic share inside each event window against the rest, top ``k`` by change."""
    dated = df.filter(F.col(ts_col).isNotNull()).dropna(subset=[by, topic])
    overall = dated.groupBy(by, topic).agg(F.count(F.lit(1)).alias("all_n"))
    inside = in_event_window(dated, events, ts_col, days).groupBy("event", by, topic).agg(F.count(F.lit(1)).alias("in_n"))
    seen = inside.select("event", by).distinct()
    cells = (
        overall.join(seen, by)
        .join(inside, ["event", by, topic], "left")
        .na.fill(0, ["in_n"])
        .withColumn("out_n", F.col("all_n") - F.col("in_n"))
    )
    whole = W.partitionBy("event", by)
    shares = cells.select(
        "event", by, topic,
        (F.col("in_n") * 100.0 / F.nullif(F.sum("in_n").over(whole), F.lit(0))).alias("window_share"),
        (F.col("out_n") * 100.0 / F.nullif(F.sum("out_n").over(whole), F.lit(0))).alias("baseline_share"),
    ).na.fill(0.0, ["window_share", "baseline_share"])
    shares = shares.withColumn("abs_diff", F.abs(F.col("window_share") - F.col("baseline_share")))
    rank = F.row_number().over(whole.orderBy(F.round("abs_diff", 9).desc(), F.col(topic).asc()))
    return shares.withColumn("rank", rank).filter(F.col("rank") <= k)


def volume(df: DataFrame, ts_col: str, by: str, groups: Sequence[str]) -> DataFrame:
    """Articles per month and group, 0 where a group has none in a month of the union."""
    return pivot_counts(df.withColumn("month", month_of(F.col(ts_col))), "month", by, groups)


def monthly_means(df: DataFrame, ts_col: str, by: str, metrics: Sequence[str]) -> DataFrame:
    return (
        df.filter(F.col(ts_col).isNotNull() & F.col(by).isNotNull())
        .groupBy(month_of(F.col(ts_col)).alias("month"), by)
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])
    )


def calendar_spine(series: DataFrame, by: str, value_cols: Sequence[str], month_col: str = "month") -> DataFrame:
    """Every month of the overlap of all groups' ranges per group; absent is NULL.

    ``series`` is already monthly, so everything here is calendar-sized.
    """
    ranges = series.groupBy(by).agg(F.min(month_col).alias("_lo"), F.max(month_col).alias("_hi"))
    overlap = ranges.groupBy().agg(
        F.max("_lo").alias("_from"), F.min("_hi").alias("_to"), F.collect_list(by).alias("_groups")
    )
    spine = (
        overlap.filter("_from <= _to")
        .select("_groups", F.posexplode(F.sequence("_from", "_to", F.expr("INTERVAL 1 MONTH"))).alias("month_index", month_col))
        .select("month_index", month_col, F.explode("_groups").alias(by))
    )
    return spine.join(series.select(by, month_col, *value_cols), [by, month_col], "left")


def topic_mix_by_month(df: DataFrame, ts_col: str, by: str, topic: str, k: int = 8) -> DataFrame:
    """Topic percent within (month, group) for the ``k`` topics most frequent overall."""
    monthly = df.withColumn("month", month_of(F.col(ts_col)))
    mix = value_share(monthly, topic, ["month", by])
    top = top_k_per_group(
        df.filter(F.col(ts_col).isNotNull()).withColumn("_all", F.lit(0)), "_all", topic, k
    ).select(topic)
    return mix.join(top, topic, "left_semi")


def average_rank(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Ranks with ties averaged, over an already aggregated series."""
    low = F.rank().over(W.partitionBy(*by).orderBy(value))
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, value))
    return df.withColumn(out, low + (ties - 1) / 2.0)


@F.pandas_udf(T.DoubleType())
def student_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a rank correlation from the t distribution."""
    return pd.Series([_correlation_p(r, k) for r, k in zip(rho, n)])


def _correlation_p(rho: float, n: float) -> float | None:
    if rho is None or n is None or math.isnan(rho) or n < 3:
        return None
    if abs(rho) >= 1.0:
        return 0.0
    dof = n - 2
    # P(|T| > t) = I_{dof / (dof + t^2)}(dof / 2, 1/2), and dof / (dof + t^2) = 1 - rho^2.
    return _incomplete_beta(dof / 2.0, 0.5, 1.0 - rho * rho)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    scale = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + term / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return scale * (f - 1.0)


def spearman_trend(series: DataFrame, by: str, metrics: Sequence[str], index: str = "month_index") -> DataFrame:
    """Rank correlation of each metric with time, per group and for all groups together.

    ``(dataset, metric, n, rho, p_value)``; NULL pairs are dropped.  Input is a
    monthly series, so each (dataset, metric) window is calendar-sized.
    """
    tall = series.unpivot([by, index], list(metrics), "metric", "value").filter(F.col("value").isNotNull())
    both = tall.select(F.explode(F.array(F.lit("All"), F.col(by).cast("string"))).alias("dataset"), "metric", index, "value")
    keys = ["dataset", "metric"]
    ranked = average_rank(average_rank(both, index, keys, "_rx"), "value", keys, "_ry")
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))
    return out.withColumn("p_value", student_p(F.col("rho"), F.col("n").cast("double")))


def lowess(series: DataFrame, x: str, y: str, by: Sequence[str], frac: float = 2.0 / 3.0, passes: int = 3) -> DataFrame:
    """LOESS curve per series: local tricube-weighted lines, robustness passes.

    One task smooths one series, which is an aggregated series with one point per
    calendar step; raw rows must be aggregated first.  Series with three points
    or fewer give no curve.
    """
    keys = list(by)
    points = series.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable")
        if len(pdf) <= 3:
            return pdf.iloc[:0].assign(fitted=0.0).drop(columns="y")
        fitted = lowess_fit(pdf["x"].to_numpy(), pdf["y"].to_numpy(), frac, passes)
        return pdf.drop(columns="y").assign(fitted=fitted)

    types = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    return points.groupBy(*keys).applyInPandas(smooth, f"{types}, x double, fitted double")


def lowess_fit(x: np.ndarray, y: np.ndarray, frac: float, passes: int) -> np.ndarray:
    n = len(x)
    near = min(max(int(frac * n + 1e-10), 2), n)
    robust = np.ones(n)
    for turn in range(passes + 1):
        fitted = np.empty(n)
        for i in range(n):
            gap = np.abs(x - x[i])
            reach = np.partition(gap, near - 1)[near - 1]
            u = gap / reach if reach > 0 else np.where(gap > 0, 2.0, 0.0)
            w = np.where(u < 0.999, (1 - np.minimum(u, 1.0) ** 3) ** 3, 0.0) * robust
            w = np.where(u <= 0.001, robust, w)
            total = w.sum()
            if total <= 0:
                fitted[i] = y[i]
                continue
            centre = (w * x).sum() / total
            spread = (w * (x - centre) ** 2).sum()
            slope = (w * (x - centre) * y).sum() / spread if spread > 1e-12 else 0.0
            fitted[i] = (w * y).sum() / total + slope * (x[i] - centre)
        if turn == passes:
            return fitted
        residual = np.abs(y - fitted)
        scale = 6.0 * np.median(residual)
        if scale <= 1e-12:
            return fitted
        v = residual / scale
        robust = np.where(v < 0.999, (1 - np.minimum(v, 1.0) ** 2) ** 2, 0.0)
        robust = np.where(v <= 0.001, 1.0, robust)
    return fitted

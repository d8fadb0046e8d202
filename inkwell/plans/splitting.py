"""Queries: splits, folds and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import splits as sp
from inkwell.plans.registry import query
from inkwell.plans.views import articles, headlines

RANKED = """@articles, ranked AS (SELECT doc_id, outlet, ts,
        row_number() OVER (ORDER BY ts, md5(doc_id::VARCHAR)) AS rn, count(*) OVER () AS n FROM articles WHERE ts IS NOT NULL),
    split AS (SELECT doc_id, outlet, ts, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split FROM ranked
        UNION ALL SELECT doc_id, outlet, ts, 'train' FROM articles WHERE ts IS NULL)"""

NEWEST = """@articles, ranked AS (SELECT doc_id, outlet, ts,
        row_number() OVER (PARTITION BY outlet ORDER BY ts DESC, md5(doc_id::VARCHAR) DESC) AS rn,
        count(*) OVER (PARTITION BY outlet) AS n FROM articles WHERE ts IS NOT NULL),
    split AS (SELECT doc_id, outlet, ts, CASE WHEN rn <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' ELSE 'train' END AS split FROM ranked
        UNION ALL SELECT doc_id, outlet, ts, 'train' FROM articles WHERE ts IS NULL)"""


def _dated(spark, d):
    return articles(spark, d).select("doc_id", "outlet", "ts")


@query(f"WITH {RANKED} SELECT doc_id, split FROM split")
def temporal_split(spark, d):
    return sp.temporal_split(_dated(spark, d), "ts", "doc_id", 0.8).select("doc_id", "split")


@query(f"WITH {NEWEST} SELECT doc_id, outlet, split FROM split")
def time_stratified_split(spark, d):
    return sp.time_stratified_split(_dated(spark, d), "outlet", "ts", "doc_id", 0.2).select("doc_id", "outlet", "split")


@query("""WITH @articles, ranked AS (SELECT doc_id, row_number() OVER (ORDER BY ts, md5(doc_id::VARCHAR)) AS rn,
        count(*) OVER () AS n FROM articles WHERE ts IS NOT NULL),
    s AS (SELECT doc_id, CASE WHEN rn <= n - 5 * (n // 6) THEN 0 ELSE (rn - (n - 5 * (n // 6)) - 1) // (n // 6) + 1 END AS slice FROM ranked
        UNION ALL SELECT doc_id, 0 FROM articles WHERE ts IS NULL)
    SELECT s.doc_id, f.fold, CASE WHEN s.slice = f.fold + 1 THEN 'validate' ELSE 'train' END AS role
    FROM s JOIN range(5) AS f(fold) ON s.slice <= f.fold + 1""")
def rolling_folds(spark, d):
    return sp.rolling_folds(_dated(spark, d), "ts", "doc_id", 5).select("doc_id", "fold", "role")


@query("""WITH @headlines, r AS (SELECT doc_id, outlet, row_number() OVER (PARTITION BY outlet ORDER BY md5(doc_id::VARCHAR || '|7')) AS rn,
        count(*) OVER (PARTITION BY outlet) AS n FROM headlines)
    SELECT doc_id, outlet, CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, d):
    return sp.stratified_split(headlines(spark, d).select("doc_id", "outlet"), "outlet", "doc_id", 0.2, 7)


@query("""WITH @headlines, r AS (SELECT doc_id, outlet,
        row_number() OVER (PARTITION BY outlet ORDER BY md5(doc_id::VARCHAR || '|0')) AS r0,
        row_number() OVER (PARTITION BY outlet ORDER BY md5(doc_id::VARCHAR || '|1')) AS r1,
        count(*) OVER (PARTITION BY outlet) AS n FROM headlines)
    SELECT doc_id, outlet, (r0 - 1) * 3 // n AS fold_0, (r1 - 1) * 3 // n AS fold_1 FROM r""")
def repeated_folds(spark, d):
    return sp.repeated_folds(headlines(spark, d).select("doc_id", "outlet"), "outlet", "doc_id", 3, 2, 0)


@query(f"""WITH {RANKED}, g AS (SELECT avg((outlet = 'A')::INT) FILTER (split = 'train') AS a,
        avg((outlet = 'A')::INT) FILTER (split = 'test') AS b FROM split)
    SELECT round(a, 6) AS train_share, round(b, 6) AS test_share, abs(a - b) > 0.2 AS fall_back FROM g""")
def split_guard(spark, d):
    return sp.split_guard(sp.temporal_split(_dated(spark, d), "ts", "doc_id", 0.8), "A", "outlet", 0.2)


@query(f"""WITH {NEWEST} SELECT split, outlet, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts,
    sum(count(*)) OVER (PARTITION BY split)::BIGINT AS split_rows,
    round(count(*) / sum(count(*)) OVER (PARTITION BY split)::DOUBLE, 6) AS share FROM split GROUP BY split, outlet""")
def split_summary(spark, d):
    split = sp.time_stratified_split(_dated(spark, d), "outlet", "ts", "doc_id", 0.2)
    return sp.split_summary(split, "outlet", "ts")


@query(f"""WITH {NEWEST} SELECT outlet, min(ts) FILTER (split = 'train') AS train_min, max(ts) FILTER (split = 'train') AS train_max,
    min(ts) FILTER (split = 'test') AS test_min, max(ts) FILTER (split = 'test') AS test_max FROM split GROUP BY outlet""")
def split_ranges(spark, d):
    split = sp.time_stratified_split(_dated(spark, d), "outlet", "ts", "doc_id", 0.2)
    return sp.split_ranges(split, "outlet", "ts")


@query(r"""WITH @headlines, w AS (SELECT doc_id, title, [x FOR x IN regexp_split_to_array(title, '\s+') IF x <> ''] AS words FROM headlines),
    p AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM w),
    k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p
        WHERE ('0x' || left(md5(doc_id || '|' || i || '|0'), 8))::BIGINT / 4294967296.0::DOUBLE >= 0.1 GROUP BY doc_id)
    SELECT doc_id, title, 0::BIGINT AS augmented FROM headlines
    UNION ALL SELECT w.doc_id, CASE WHEN len(w.words) > 2 AND k.kept IS NOT NULL THEN k.kept ELSE w.title END, 1
    FROM w LEFT JOIN k ON k.doc_id = w.doc_id""")
def word_dropout(spark, d):
    return sp.word_dropout_rows(headlines(spark, d).select("doc_id", "title"), "title", "doc_id", 0.1, 0)


@query(r"""WITH @articles SELECT doc_id, title AS title_only, trim(title || ' ' || coalesce(subtitle, ''), chr(10) || ' ') AS full_text,
    CASE WHEN ('0x' || left(md5(doc_id || '|3'), 8))::BIGINT / 4294967296.0::DOUBLE < 0.5
        THEN trim(title || ' ' || coalesce(subtitle, ''), chr(10) || ' ') ELSE title END AS mixed FROM articles""")
def title_with_subtitle(spark, d):
    title, subtitle = F.col("title"), F.col("subtitle")
    return articles(spark, d).select(
        "doc_id", tx.title_with_subtitle(title, subtitle, "title").alias("title_only"),
        tx.title_with_subtitle(title, subtitle, "full").alias("full_text"),
        tx.title_with_subtitle(title, subtitle, "mix", F.col("doc_id"), 3).alias("mixed"),
    )

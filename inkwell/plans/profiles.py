"""Queries: profiles, group comparisons, top-k, time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as tx
from inkwell.operators import profile as pf, temporal as tm
from inkwell.plans.registry import query
from inkwell.plans.views import articles, headlines, orders, pages, story_events, table


@query("""WITH @headlines SELECT outlet, count(*) AS n, round(count(*) * 1.0::DOUBLE / (SELECT count(*) FROM headlines), 6) AS share
    FROM headlines GROUP BY outlet""")
def class_balance(spark, d):
    return pf.class_balance(headlines(spark, d), "outlet")


@query("""WITH @articles SELECT outlet, topic, count(*) AS n,
    round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY outlet), 6) AS share
    FROM articles WHERE topic IS NOT NULL GROUP BY outlet, topic""")
def value_share(spark, d):
    return pf.value_share(articles(spark, d), "topic", ["outlet"])


@query("""WITH @headlines SELECT category, count(*) FILTER (outlet = 'A') AS "A", count(*) FILTER (outlet = 'B') AS "B",
    round(count(*) FILTER (outlet = 'A') / count(*)::DOUBLE, 6) AS "A_share" FROM headlines GROUP BY category""")
def pivot_counts(spark, d):
    return pf.pivot_counts(headlines(spark, d), "category", "outlet", ["A", "B"], share_of="A")


@query(r"""WITH @headlines, f AS (SELECT category, outlet, length(title) AS chars,
        length(regexp_replace(title, '[^!]', '', 'g')) AS marks FROM headlines)
    SELECT category, outlet, count(*) AS n, round(avg(chars), 6) AS mean_chars, round(avg(marks), 6) AS mean_marks
    FROM f GROUP BY category, outlet""")
def grouped_summary(spark, d):
    df = headlines(spark, d).withColumns(
        {"chars": F.length("title"), "marks": tx.punct_counts_6(F.col("title"))["n_exclaim"]}
    )
    return pf.grouped_summary(
        df, ["category", "outlet"], {"mean_chars": F.avg("chars"), "mean_marks": F.avg("marks")}, 6
    )


WORDS_SQL = r"len([w FOR w IN regexp_split_to_array(title, '\s+') IF w <> ''])"


@query(f"""WITH @headlines, f AS (SELECT outlet, {WORDS_SQL} AS word_count FROM headlines)
    SELECT outlet, count(*) AS count, round(avg(word_count), 6) AS mean, round(stddev_samp(word_count), 6) AS std,
        min(word_count) AS min, round(quantile_cont(word_count, 0.25), 6) AS p25, round(quantile_cont(word_count, 0.5), 6) AS p50,
        round(quantile_cont(word_count, 0.75), 6) AS p75, max(word_count) AS max FROM f GROUP BY outlet""")
def describe_by(spark, d):
    df = headlines(spark, d).withColumn("word_count", tx.n_words(F.col("title")))
    return pf.describe_by(df, ["outlet"], "word_count")


@query("""WITH @articles SELECT outlet, min(ts) AS first_ts, max(ts) AS last_ts, count(ts) AS dated, count(*) AS total,
    count(*) FILTER (ts IS NULL) AS undated FROM articles GROUP BY outlet""")
def time_coverage(spark, d):
    return pf.time_coverage(articles(spark, d), "outlet", "ts")


@query("""WITH @articles, m AS (SELECT outlet, author IS NULL OR trim(author) = '' AS a, subtitle IS NULL OR trim(subtitle) = '' AS s,
        ts IS NULL AS t FROM articles)
    SELECT outlet, count(*) AS rows, 'author' AS "column", count(*) FILTER (a) AS missing FROM m GROUP BY outlet
    UNION ALL SELECT outlet, count(*), 'subtitle', count(*) FILTER (s) FROM m GROUP BY outlet
    UNION ALL SELECT outlet, count(*), 'ts', count(*) FILTER (t) FROM m GROUP BY outlet
    UNION ALL SELECT outlet, count(*), '<any>', count(*) FILTER (a OR s OR t) FROM m GROUP BY outlet""")
def na_profile(spark, d):
    return pf.na_profile(articles(spark, d), "outlet", ["author", "subtitle", "ts"])


@query("""WITH @articles, m AS (
        SELECT doc_id, 'author' AS "column" FROM articles WHERE author IS NULL OR trim(author) = ''
        UNION ALL SELECT doc_id, 'ts' FROM articles WHERE ts IS NULL)
    SELECT doc_id, "column" FROM m QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY doc_id) <= 5""")
def na_examples(spark, d):
    return pf.na_examples(articles(spark, d), ["author", "ts"], "doc_id", 5)


TOKEN_RUN = r"[\p{L}\p{N}_]+"
CAPS3_SQL = rf"len([w FOR w IN regexp_extract_all(title, '{TOKEN_RUN}') IF regexp_full_match(w, '[A-Z]{{3,}}')])"


@query(rf"""WITH @headlines, f AS (SELECT outlet, regexp_matches(title, '''[^'']{{1,40}}''')::DOUBLE AS has_single_quotes,
        (title LIKE '%?')::DOUBLE AS ends_question, contains(title, ':')::DOUBLE AS has_colon,
        ({CAPS3_SQL} > 0)::DOUBLE AS has_caps3, regexp_matches(title, '^[0-9]')::DOUBLE AS starts_with_number FROM headlines)
    SELECT outlet, flag, round(100.0 * avg(v), 6) AS rate FROM (UNPIVOT f ON has_single_quotes, ends_question, has_colon, has_caps3,
        starts_with_number INTO NAME flag VALUE v) GROUP BY outlet, flag""")
def flag_rates(spark, d):
    flags = ["has_single_quotes", "ends_question", "has_colon", "has_caps3", "starts_with_number"]
    return pf.flag_rates(tx.with_features(headlines(spark, d), "title", tx.eda_flags), "outlet", flags)


EFFECT_FEATURES = [
    "n_words", "len_chars", "mean_word_len", "digit_ratio", "n_comma", "exclamation_count",
    "allcaps_word_count", "type_token_ratio",
]
EFFECT_SQL = r"""WITH @headlines, w AS (SELECT outlet, title,
        [w FOR w IN regexp_split_to_array(title, '\s+') IF w <> ''] AS words FROM headlines),
    f AS (SELECT outlet, greatest(len(words), 1)::DOUBLE AS n_words, length(title)::DOUBLE AS len_chars,
        length(regexp_replace(title, '\s+', '', 'g')) / greatest(len(words), 1)::DOUBLE AS mean_word_len,
        length(regexp_replace(title, '[^0-9]', '', 'g')) / greatest(length(title), 1)::DOUBLE AS digit_ratio,
        length(regexp_replace(title, '[^,]', '', 'g'))::DOUBLE AS n_comma,
        length(regexp_replace(title, '[^!]', '', 'g'))::DOUBLE AS exclamation_count,
        len([x FOR x IN words IF length(x) > 1 AND regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}')])::DOUBLE AS allcaps_word_count,
        len(list_distinct(words)) / greatest(len(words), 1)::DOUBLE AS type_token_ratio FROM w),
    u AS (UNPIVOT f ON n_words, len_chars, mean_word_len, digit_ratio, n_comma, exclamation_count, allcaps_word_count,
        type_token_ratio INTO NAME feature VALUE v),
    s AS (SELECT feature, count(*) FILTER (outlet = 'A') AS na, count(*) FILTER (outlet = 'B') AS nb,
        avg(v) FILTER (outlet = 'A') AS ma, avg(v) FILTER (outlet = 'B') AS mb,
        var_samp(v) FILTER (outlet = 'A') AS va, var_samp(v) FILTER (outlet = 'B') AS vb FROM u GROUP BY feature),
    p AS (SELECT *, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS sd FROM s)"""


@query(EFFECT_SQL + """ SELECT feature, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, round(abs(ma - mb), 6) AS abs_diff,
    round(sd, 6) AS pooled_std, round((ma - mb) / nullif(sd, 0), 6) + 0.0 AS cohens_d FROM p""")
def effect_size(spark, d):
    df = headlines(spark, d).select("outlet", "title")
    featured = tx.with_features(df, "title", tx.style_features_16, tx.style_features_18)
    return pf.effect_size(featured, "outlet", "A", "B", EFFECT_FEATURES)


@query(EFFECT_SQL + """ SELECT feature, round((ma - mb) / nullif(sd, 0), 6) + 0.0 AS cohens_d FROM p
    WHERE abs((ma - mb) / nullif(sd, 0)) > 0.05""")
def select_features(spark, d):
    df = headlines(spark, d).select("outlet", "title")
    featured = tx.with_features(df, "title", tx.style_features_16, tx.style_features_18)
    effects = pf.effect_size(featured, "outlet", "A", "B", EFFECT_FEATURES)
    return pf.select_features(effects, 0.05).select("feature", "cohens_d")


@query("""WITH @articles SELECT count(DISTINCT category) AS category, count(DISTINCT author) AS author,
    count(DISTINCT subtitle) AS subtitle, count(DISTINCT title) AS title FROM articles""")
def n_distinct(spark, d):
    return pf.n_distinct(articles(spark, d), ["category", "author", "subtitle", "title"])


@query("""WITH @headlines, s AS (SELECT outlet, lang, count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY outlet) AS share
        FROM headlines GROUP BY outlet, lang),
    w AS (SELECT lang, coalesce(max(share) FILTER (outlet = 'A'), 0) AS a, coalesce(max(share) FILTER (outlet = 'B'), 0) AS b FROM s GROUP BY lang)
    SELECT lang, round(a, 6) AS share_a, round(b, 6) AS share_b, round(abs(a - b), 6) AS abs_diff,
        CASE WHEN b = 0 THEN 'A' WHEN a = 0 THEN 'B' END AS only_in FROM w""")
def share_divergence(spark, d):
    return pf.share_divergence(headlines(spark, d), "lang", "outlet", "A", "B")


@query("""WITH @articles, g AS (SELECT * FROM (SELECT DISTINCT category FROM articles WHERE topic IS NOT NULL) a,
        (SELECT DISTINCT topic FROM articles WHERE topic IS NOT NULL) b),
    n AS (SELECT category, topic, count(*) AS n FROM articles GROUP BY category, topic)
    SELECT g.category, g.topic, coalesce(n.n, 0) AS n, round(coalesce(n.n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM articles), 6) AS percent
    FROM g LEFT JOIN n ON n.category = g.category AND n.topic = g.topic""")
def overlap_matrix(spark, d):
    return pf.overlap_matrix(articles(spark, d), "category", "topic")


@query(f"""WITH @headlines, f AS (SELECT outlet, {WORDS_SQL} AS word_count FROM headlines),
    m AS (SELECT outlet, median(word_count)::DOUBLE AS median FROM f GROUP BY outlet),
    h AS (SELECT outlet, floor(word_count / 50.0::DOUBLE) * 50 AS bin_start, count(*) AS n FROM f GROUP BY 1, 2)
    SELECT h.outlet, bin_start::DOUBLE AS bin_start, n, round(n / (sum(n) OVER (PARTITION BY h.outlet) * 50.0::DOUBLE), 6) AS density, median
    FROM h JOIN m ON m.outlet = h.outlet""")
def histogram(spark, d):
    df = headlines(spark, d).withColumn("word_count", tx.n_words(F.col("title")))
    return pf.histogram(df, "word_count", 50.0, "outlet")


@query(f"""WITH @headlines, f AS (SELECT outlet, {WORDS_SQL}::DOUBLE AS x FROM headlines),
    b AS (SELECT outlet, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS h FROM f GROUP BY outlet),
    g AS (SELECT i, i * 2000.0::DOUBLE / 24 AS grid FROM range(25) AS r(i))
    SELECT f.outlet, round(g.grid, 6) AS grid, round(1000 * sum(exp(-0.5 * ((g.grid - f.x) / b.h) * ((g.grid - f.x) / b.h)))
        / (max(b.n) * max(b.h) * sqrt(2 * pi())), 6) + 0.0 AS density_x1000
    FROM f JOIN b ON b.outlet = f.outlet, g GROUP BY f.outlet, g.i, g.grid""")
def density_curve(spark, d):
    df = headlines(spark, d).withColumn("word_count", tx.n_words(F.col("title")))
    curve = pf.density_curve(df, "word_count", "outlet", 0.0, 2000.0, 25)
    return curve.select("outlet", "grid", (F.col("density") * 1000).alias("density_x1000"))


@query("""SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) FILTER (o_orderstatus = 'F') AS "F",
    count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def volume(spark, d):
    return tm.volume(orders(spark, d), "o_orderdate", "o_orderstatus", ["F", "O", "P"])


@query("""WITH p AS (SELECT event_type, 'hour' AS part, hour(ts)::VARCHAR AS value, hour(ts) AS position FROM events
        UNION ALL SELECT event_type, 'weekday', dayname(ts), isodow(ts) - 1 FROM events)
    SELECT event_type, part, value, position, count(*) AS n,
        round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY event_type, part), 6) AS percent
    FROM p GROUP BY event_type, part, value, position""")
def posting_profile(spark, d):
    return pf.posting_profile(table(spark, d, "events"), "event_type", "ts")


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus, o_orderpriority FROM orders),
    top AS (SELECT o_orderpriority FROM m GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
    s AS (SELECT month, o_orderstatus, o_orderpriority, count(*) AS n,
        count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY month, o_orderstatus) AS share FROM m GROUP BY 1, 2, 3)
    SELECT month, o_orderstatus, o_orderpriority, n, round(share, 6) AS share FROM s
    WHERE o_orderpriority IN (SELECT o_orderpriority FROM top)""")
def topic_mix_by_month(spark, d):
    return tm.topic_mix_by_month(orders(spark, d), "o_orderdate", "o_orderstatus", "o_orderpriority", 3)


@query(f"""WITH @articles, @story_events, f AS (SELECT doc_id, outlet, ts, {WORDS_SQL}::DOUBLE AS word_count,
        length(title)::DOUBLE AS char_count, contains(title, '!')::DOUBLE AS has_exclaim FROM articles WHERE ts IS NOT NULL),
    t AS (SELECT f.*, s.event, f.ts BETWEEN s.event_ts - INTERVAL 2 DAY AND s.event_ts + INTERVAL 2 DAY AS inside FROM f, story_events s),
    u AS (UNPIVOT t ON word_count, char_count, has_exclaim INTO NAME metric VALUE v)
    SELECT event, outlet, count(*) FILTER (inside) AS window_n, count(*) FILTER (NOT inside) AS baseline_n, metric,
        round(avg(v) FILTER (inside), 6) AS window_mean, round(avg(v) FILTER (NOT inside), 6) AS baseline_mean
    FROM u GROUP BY event, outlet, metric HAVING count(*) FILTER (inside) > 0""")
def event_shift(spark, d):
    df = articles(spark, d).select(
        "outlet", "ts", tx.n_words(F.col("title")).alias("word_count"), F.length("title").alias("char_count"),
        F.col("title").contains("!").cast("int").alias("has_exclaim"),
    )
    return tm.event_shift(df, story_events(spark), "ts", "outlet", ["word_count", "char_count", "has_exclaim"], 2)


@query("""WITH @articles, @story_events, t AS (SELECT a.outlet, a.topic, s.event,
        a.ts BETWEEN s.event_ts - INTERVAL 2 DAY AND s.event_ts + INTERVAL 2 DAY AS inside
        FROM articles a, story_events s WHERE a.ts IS NOT NULL AND a.topic IS NOT NULL),
    c AS (SELECT event, outlet, topic, count(*) FILTER (inside) AS i, count(*) FILTER (NOT inside) AS o FROM t GROUP BY 1, 2, 3),
    s AS (SELECT event, outlet, topic, coalesce(i * 100.0::DOUBLE / nullif(sum(i) OVER w, 0), 0) AS ws,
        coalesce(o * 100.0::DOUBLE / nullif(sum(o) OVER w, 0), 0) AS bs FROM c WINDOW w AS (PARTITION BY event, outlet)),
    r AS (SELECT *, row_number() OVER (PARTITION BY event, outlet ORDER BY round(abs(ws - bs), 9) DESC, topic) AS rank FROM s)
    SELECT event, outlet, topic, round(ws, 6) AS window_share, round(bs, 6) AS baseline_share, round(abs(ws - bs), 6) AS abs_diff, rank
    FROM r WHERE rank <= 3""")
def event_topic_shift(spark, d):
    df = articles(spark, d).select("outlet", "ts", "topic")
    return tm.event_topic_shift(df, story_events(spark), "ts", "outlet", "topic", 2, 3)


@query(f"""WITH @headlines, f AS (SELECT {WORDS_SQL} AS n FROM headlines)
    SELECT count(*) AS rows, round(avg(n), 6) AS mean_tokens, max(n) AS max_tokens, count(*) FILTER (n >= 64) AS at_limit FROM f""")
def token_length_stats(spark, d):
    return pf.token_length_stats(headlines(spark, d), tx.n_words(F.col("title")), 64)


@query("""WITH @articles, m AS (SELECT doc_id, trim(coalesce(author, '')) = '' AS a, ts IS NULL AS t, lang = 'en' AS live FROM articles)
    SELECT count(*) FILTER (a OR t) AS rows_with_gap, count(*) FILTER ((a OR t) AND live) AS live_with_gap,
        count(*) FILTER ((a OR t) AND NOT live) AS other_with_gap, count(*) FILTER (a) AS missing_author,
        count(*) FILTER (t) AS missing_ts, count(DISTINCT doc_id) FILTER (a OR t) AS keys_to_refill FROM m""")
def gap_report(spark, d):
    kind = F.when(F.col("lang") == "en", "live").otherwise("article")
    return pf.gap_report(articles(spark, d), "doc_id", "author", "ts", kind)


@query("""WITH @articles SELECT category, count(*) AS missing FROM articles WHERE trim(coalesce(subtitle, '')) = '' GROUP BY category""")
def missing_by(spark, d):
    return pf.missing_by(articles(spark, d), "subtitle", "category")


@query(r"""SELECT 'html' AS pattern, count(*) FILTER (regexp_matches(url, '\.html$')) AS n FROM pages
    UNION ALL SELECT 'fragment', count(*) FILTER (contains(url, '#')) FROM pages
    UNION ALL SELECT 'blog', count(*) FILTER (regexp_matches(url, '://blog\.')) FROM pages
    UNION ALL SELECT 'english', count(*) FILTER (contains(url, '/en/')) FROM pages""")
def url_pattern_counts(spark, d):
    patterns = {"html": r"\.html$", "fragment": "#", "blog": r"://blog\.", "english": "/en/"}
    return pf.url_pattern_counts(pages(spark, d), "url", patterns)


@query("""WITH @articles SELECT author, count(*) AS n FROM articles WHERE author IS NOT NULL GROUP BY author ORDER BY n DESC, author LIMIT 10""")
def top_n(spark, d):
    counts = articles(spark, d).filter(F.col("author").isNotNull()).groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    return pf.top_n(counts, F.col("n"), 10, "author")


@query("""WITH @articles, c AS (SELECT outlet, category, count(*) AS n FROM articles GROUP BY outlet, category)
    SELECT outlet, category, n, row_number() OVER (PARTITION BY outlet ORDER BY n DESC, category) AS rank FROM c
    QUALIFY row_number() OVER (PARTITION BY outlet ORDER BY n DESC, category) <= 8""")
def top_k_per_group(spark, d):
    return pf.top_k_per_group(articles(spark, d), "outlet", "category", 8)


@query("""WITH @headlines SELECT doc_id, outlet, category FROM headlines
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5(doc_id::VARCHAR || '|42')) <= 3""")
def sample_rows(spark, d):
    return pf.sample_rows(headlines(spark, d).select("doc_id", "outlet", "category"), "doc_id", 3, 42, "category")


MONTHLY_SQL = """monthly AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus || o_orderpriority AS status, count(*) AS n,
        avg(o_totalprice) AS price FROM orders GROUP BY 1, 2),
    r AS (SELECT status, min(month) AS lo, max(month) AS hi FROM monthly GROUP BY status),
    o AS (SELECT max(lo) AS f, min(hi) AS t FROM r),
    sp AS (SELECT unnest(generate_series(f::TIMESTAMP, t::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM o),
    ix AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS month_index FROM sp),
    spine AS (SELECT r.status, ix.month, ix.month_index, m.n, m.price FROM ix, r LEFT JOIN monthly m ON m.status = r.status AND m.month = ix.month)"""


def _monthly(spark, d):
    """All orders per month, status and priority: fine enough to leave empty months."""
    rows = orders(spark, d).withColumn("status", F.concat("o_orderstatus", "o_orderpriority"))
    series = tm.monthly_means(rows, "o_orderdate", "status", ["o_totalprice"]).withColumnRenamed("o_totalprice", "price")
    return tm.calendar_spine(series, "status", ["n", "price"])


@query(f"WITH {MONTHLY_SQL} SELECT status, month, month_index, n, round(price, 6) AS price FROM spine")
def calendar_spine(spark, d):
    return _monthly(spark, d)


@query(f"""WITH {MONTHLY_SQL}, both_sets AS (SELECT status AS dataset, month_index, price FROM spine WHERE price IS NOT NULL
        UNION ALL SELECT 'All', month_index, price FROM spine WHERE price IS NOT NULL),
    k AS (SELECT dataset, rank() OVER (PARTITION BY dataset ORDER BY month_index)
            + (count(*) OVER (PARTITION BY dataset, month_index) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (PARTITION BY dataset ORDER BY price) + (count(*) OVER (PARTITION BY dataset, price) - 1) / 2.0::DOUBLE AS ry FROM both_sets)
    SELECT dataset, 'price' AS metric, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho FROM k GROUP BY dataset""")
def spearman_trend(spark, d):
    return tm.spearman_trend(_monthly(spark, d), "status", ["price"]).drop("p_value")


@query()
def spearman_significant(spark, d):
    """Trends with their p-values, kept below 0.5 on this synthetic series."""
    monthly = tm.monthly_means(orders(spark, d), "o_orderdate", "o_orderstatus", ["o_totalprice"])
    spine = tm.calendar_spine(monthly, "o_orderstatus", ["n", "o_totalprice"])
    return tm.spearman_trend(spine, "o_orderstatus", ["n", "o_totalprice"]).filter("p_value < 0.5")


@query()
def lowess(spark, d):
    monthly = tm.monthly_means(orders(spark, d), "o_orderdate", "o_orderstatus", ["o_totalprice"])
    spine = tm.calendar_spine(monthly, "o_orderstatus", ["n", "o_totalprice"])
    return tm.lowess(spine, "month_index", "o_totalprice", ["o_orderstatus"])

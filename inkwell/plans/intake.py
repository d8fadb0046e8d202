"""Queries: sources, filters, labels, joins, key sets, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from inkwell.functions.text import is_missing
from inkwell.functions import urls
from inkwell.operators import hygiene as hy, temporal as tm
from inkwell.plans.registry import query
from inkwell.plans.views import articles, headlines, pages, story_events, table
from inkwell.session import scratch_path
from inkwell.sources import articles as src


@query("SELECT doc_id, text, lang, source FROM documents")
def read_articles(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "articles-csv")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    src.write_table(docs, path, "csv")
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("text", "lang", "source")]
    )
    return src.read_articles(spark, path, schema, required=("doc_id", "text"))


@query(
    """SELECT doc_id, text, lang, NULL::BIGINT AS n_chars FROM documents WHERE lang = 'en'
    UNION ALL SELECT doc_id, text, NULL AS lang, n_chars FROM documents WHERE lang <> 'en'"""
)
def union_batches(spark, d):
    docs = table(spark, d, "documents")
    english = docs.filter("lang = 'en'").select("doc_id", "text", "lang")
    other = docs.filter("lang <> 'en'").select("doc_id", "text", "n_chars")
    return src.union_batches([english, other])


@query(
    """SELECT 'documents' AS table_name, 'text' AS headline, NULL::VARCHAR AS url, 'source' AS label, count(*) AS n FROM documents
    UNION ALL SELECT 'pages', 'page_id', 'url', NULL, count(*) FROM pages
    UNION ALL SELECT 'embeddings', 'vec_id', NULL, 'label', count(*) FROM embeddings"""
)
def discover_roles(spark, d):
    out = None
    for name in ("documents", "pages", "embeddings"):
        df = table(spark, d, name)
        roles = src.discover_roles(df)
        row = df.agg(
            F.lit(name).alias("table_name"),
            *[F.lit(roles[r]).cast("string").alias(r) for r in ("headline", "url", "label")],
            F.count(F.lit(1)).alias("n"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query(
    """WITH @articles
    SELECT doc_id, 'accepted' AS outcome, NULL::VARCHAR AS error FROM articles
      WHERE ts IS NOT NULL AND trim(author) <> ''
    UNION ALL SELECT doc_id, 'rejected', CASE WHEN ts IS NULL THEN 'no date' ELSE 'no author' END FROM articles
      WHERE ts IS NULL OR trim(author) = ''"""
)
def quarantine(spark, d):
    rules = {"no date": F.col("ts").isNull(), "no author": is_missing(F.col("author"))}
    accepted, rejected = src.quarantine(articles(spark, d), rules, "doc_id")
    return accepted.select("doc_id", F.lit("accepted").alias("outcome"), F.lit(None).cast("string").alias("error")).unionByName(
        rejected.select("doc_id", F.lit("rejected").alias("outcome"), "error")
    )


@query(name="is_missing", sql=
    """WITH @articles SELECT doc_id, author IS NULL OR trim(author) = '' AS no_author,
    subtitle IS NULL OR trim(subtitle) = '' AS no_subtitle, ts IS NULL AS no_ts FROM articles"""
)
def missing_cells(spark, d):
    return articles(spark, d).select(
        "doc_id", is_missing(F.col("author")).alias("no_author"),
        is_missing(F.col("subtitle")).alias("no_subtitle"), is_missing(F.col("ts")).alias("no_ts"),
    )


@query(
    """WITH @articles, m AS (SELECT doc_id, author IS NULL OR trim(author) = '' AS a,
        subtitle IS NULL OR trim(subtitle) = '' AS s FROM articles)
    SELECT 'any' AS how, doc_id FROM m WHERE NOT (a OR s)
    UNION ALL SELECT 'all', doc_id FROM m WHERE NOT (a AND s)"""
)
def drop_missing(spark, d):
    df = articles(spark, d)
    parts = [
        hy.drop_missing(df, ["author", "subtitle"], how).select(F.lit(how).alias("how"), "doc_id")
        for how in ("any", "all")
    ]
    return parts[0].unionByName(parts[1])


HOST_RULES = {"org": ".example.org/", "net": ".example.net/"}


@query(
    """SELECT page_id, CASE WHEN contains(lower(url), '.example.org/') THEN 'org'
    WHEN contains(lower(url), '.example.net/') THEN 'net' ELSE 'other' END AS outlet FROM pages"""
)
def partition_by_host(spark, d):
    return pages(spark, d).select("page_id", urls.partition_by_host(F.col("url"), HOST_RULES).alias("outlet"))


@query("WITH @headlines SELECT doc_id, CASE WHEN outlet = 'A' THEN 1 ELSE 0 END::BIGINT AS label FROM headlines")
def encode_label(spark, d):
    return headlines(spark, d).select("doc_id", hy.encode_label(F.col("outlet"), "A").alias("label"))


@query(
    """SELECT doc_id, CASE WHEN lower(trim(source)) IN ('src0', '0') THEN 0 WHEN lower(trim(source)) IN ('src2', '1') THEN 1
        WHEN contains(lower(source), 'c1') THEN 0 WHEN starts_with(lower(source), 'src') THEN 1 END::BIGINT AS label
    FROM documents"""
)
def coerce_labels(spark, d):
    label = hy.coerce_labels(
        F.upper("source"), {0: ("src0", "0"), 1: ("src2", "1")}, contains={0: ("c1",)}, prefixes={1: ("src",)},
        strict=False,
    )
    return table(spark, d, "documents").select("doc_id", label.alias("label"))


@query(
    """SELECT page_id, CASE WHEN contains(lower(url), 'example.org') OR starts_with(lower(url), 'http://www') THEN 0
        WHEN contains(lower(url), 'example.net') THEN 1 END::BIGINT AS label FROM pages"""
)
def label_from_url(spark, d):
    rules = {0: {"contains": ["example.org"], "prefix": ["http://www"]}, 1: {"contains": ["example.net"]}}
    return pages(spark, d).select("page_id", urls.label_from_url(F.col("url"), rules).alias("label"))


@query(
    """SELECT page_id, CASE WHEN contains(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '/en/')
    THEN 'live' ELSE 'article' END AS kind FROM pages"""
)
def page_kind(spark, d):
    return pages(spark, d).select("page_id", urls.page_kind(F.col("url"), ["/EN/".lower()]).alias("kind"))


@query(
    """WITH @articles SELECT doc_id, ts, length(title) AS char_count,
    contains(title, '!')::BIGINT AS has_exclaim, outlet FROM articles"""
)
def select_final(spark, d):
    df = articles(spark, d).withColumns(
        {"char_count": F.length("title"), "has_exclaim": F.col("title").contains("!").cast("int"), "extra": F.lit(1)}
    )
    return hy.select_final(df, ["doc_id", "ts"], ["char_count", "has_exclaim"], "outlet")


@query(
    """WITH @articles, @story_events SELECT doc_id, EXISTS (SELECT 1 FROM story_events s
      WHERE a.ts BETWEEN s.event_ts - INTERVAL 2 DAY AND s.event_ts + INTERVAL 2 DAY) AS in_any_event
    FROM articles a"""
)
def event_mask(spark, d):
    return tm.event_mask(articles(spark, d), story_events(spark), "ts", 2).select("doc_id", "in_any_event")


def predictions(spark, d) -> DataFrame:
    """A rule's predictions, so that evaluation tables have an SQL counterpart."""
    return headlines(spark, d).select(
        "doc_id", "category", "lang",
        F.when(F.col("outlet") == "A", 1).otherwise(0).alias("label"),
        F.when(F.lower("title").contains(" the "), 1).otherwise(0).alias("prediction"),
    )


PREDICTIONS_SQL = """@headlines, predictions AS (SELECT doc_id, category, lang,
    CASE WHEN outlet = 'A' THEN 1 ELSE 0 END AS label,
    CASE WHEN contains(lower(title), ' the ') THEN 1 ELSE 0 END AS prediction FROM headlines)"""


@query(
    f"""WITH {PREDICTIONS_SQL} SELECT doc_id, prediction::BIGINT AS direction FROM predictions WHERE label <> prediction"""
)
def error_rows(spark, d):
    pred = predictions(spark, d)
    parts = [hy.error_rows(pred, "label", "prediction", side) for side in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", F.col("prediction").alias("direction"))


@query("SELECT d.doc_id, d.lang, l.quality::BIGINT AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def attach_topics(spark, d):
    topics = table(spark, d, "labels").select("doc_id", "quality")
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return hy.attach_topics(docs, topics, "doc_id", assert_unique=True)


@query(
    """WITH k AS (SELECT page_id, lower(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '')) AS url_key,
        contains(url, '?') AS seen FROM pages)
    SELECT page_id, url_key FROM k WHERE url_key NOT IN (SELECT url_key FROM k WHERE seen)"""
)
def unseen(spark, d):
    keyed = pages(spark, d).select("page_id", "url", urls.url_match_key(F.col("url")).alias("url_key"))
    return hy.unseen(keyed.select("page_id", "url_key"), keyed.filter(F.col("url").contains("?")), "url_key")


@query(
    """WITH @articles, m AS (SELECT author IS NULL OR trim(author) = '' AS a, ts IS NULL AS b FROM articles)
    SELECT count(*) FILTER (a) AS missing_a, count(*) FILTER (b) AS missing_b,
           count(*) FILTER (a AND b) AS missing_both, count(*) FILTER (a AND NOT b) AS missing_a_only FROM m"""
)
def missing_overlap(spark, d):
    return hy.missing_overlap(articles(spark, d).withColumn("ts", F.col("ts").cast("string")), "author", "ts")


@query(
    """SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END AS language
    FROM documents"""
)
def decode(spark, d):
    names = spark.createDataFrame(
        [("en", "English"), ("de", "German"), ("fr", "French")], "code string, name string"
    )
    return hy.decode(table(spark, d, "documents").select("doc_id", "lang"), "lang", names, "code", "name", "language")


@query(
    """WITH @articles, @story_events SELECT a.doc_id, s.event FROM articles a JOIN story_events s
    ON a.ts BETWEEN s.event_ts - INTERVAL 2 DAY AND s.event_ts + INTERVAL 2 DAY"""
)
def in_event_window(spark, d):
    return tm.in_event_window(articles(spark, d), story_events(spark), "ts", 2).select("doc_id", "event")


@query(
    """WITH @articles, patch AS (
        SELECT a.doc_id, CASE WHEN e.event_type = 'view' THEN ' ' ELSE 'desk ' || e.user_id END AS author, e.event_type AS topic
        FROM articles a JOIN events e ON e.event_id = a.doc_id * 10 + 1)
    SELECT a.doc_id,
        CASE WHEN trim(coalesce(a.author, '')) = '' THEN p.author ELSE a.author END AS author,
        CASE WHEN trim(coalesce(a.subtitle, '')) = '' THEN p.topic ELSE a.subtitle END AS subtitle,
        (trim(coalesce(a.author, '')) = '' AND trim(coalesce(p.author, '')) <> '')::BIGINT AS filled_author,
        (trim(coalesce(a.subtitle, '')) = '' AND trim(coalesce(p.topic, '')) <> '')::BIGINT AS filled_subtitle
    FROM articles a LEFT JOIN patch p ON p.doc_id = a.doc_id"""
)
def backfill(spark, d):
    base = articles(spark, d).select(F.col("doc_id").cast("string").alias("key"), "author", "subtitle")
    docs = table(spark, d, "documents").select("doc_id")
    events = table(spark, d, "events").select("event_id", "event_type", "user_id")
    patch = docs.join(events, F.col("event_id") == F.col("doc_id") * 10 + 1).select(
        F.col("doc_id").cast("string").alias("key"),
        F.when(F.col("event_type") == "view", " ").otherwise(F.concat(F.lit("desk "), F.col("user_id").cast("string"))).alias("author"),
        F.col("event_type").alias("subtitle"),
    )
    filled = hy.backfill(base, patch, "key", ["author", "subtitle"])
    return filled.select(F.col("key").cast("bigint").alias("doc_id"), "author", "subtitle", "filled_author", "filled_subtitle")


@query(
    """WITH @headlines SELECT category, count(*) FILTER (outlet = 'A') AS "A", count(*) FILTER (outlet = 'B') AS "B"
    FROM headlines GROUP BY category"""
)
def align_groups(spark, d):
    from inkwell.operators.profile import align_groups as op

    return op(headlines(spark, d), "category", "outlet", ["A", "B"])


@query(
    """WITH @headlines, f AS (SELECT doc_id, category, outlet FROM headlines),
    ok AS (SELECT category FROM f GROUP BY category HAVING count(*) FILTER (outlet = 'A') > 10 AND count(*) FILTER (outlet = 'B') > 10)
    SELECT doc_id, category, outlet FROM f WHERE category IN (SELECT category FROM ok)"""
)
def restrict_shared(spark, d):
    rows = headlines(spark, d).select("doc_id", "category", "outlet")
    return hy.restrict_shared(rows, "category", "outlet", ["A", "B"], 10)


@query(
    """WITH shared AS (SELECT text FROM documents GROUP BY text HAVING count(DISTINCT source) > 1)
    SELECT doc_id, source FROM documents WHERE text NOT IN (SELECT text FROM shared)"""
)
def drop_cross_group_dupes(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "text")
    return hy.drop_cross_group_dupes(rows, "text", "source").select("doc_id", "source")


CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(title), 'https?://\S+|www\.\S+', ' ', 'g'),
    '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(
    f"""WITH @headlines, c AS (SELECT doc_id, outlet, {CLEAN_SQL} AS text_clean FROM headlines),
    r AS (SELECT *, row_number() OVER (PARTITION BY text_clean, outlet ORDER BY doc_id) AS rn FROM c WHERE text_clean <> '')
    SELECT doc_id, outlet, text_clean FROM r WHERE rn = 1"""
)
def dedup_text(spark, d):
    rows = headlines(spark, d).select("doc_id", "outlet", "title")
    return hy.dedup_text(rows, "title", "outlet", "doc_id").select("doc_id", "outlet", "text_clean")


@query(
    """SELECT doc_id, lang AS outlet FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')
    UNION ALL SELECT doc_id, 'other' FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'fr', 'de', 'es')"""
)
def stack_sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    named = ("en", "fr", "de", "es")
    sources = {n: docs.filter(F.col("lang") == n).drop("lang") for n in named}
    sources["other"] = docs.filter(F.col("lang").isNull() | ~F.col("lang").isin(*named)).drop("lang")
    return src.stack_sources(sources)


def _category_sets(spark, d):
    """Authors seen in either outlet."""
    rows = articles(spark, d).select("author", "outlet")
    return rows.filter("outlet = 'A'"), rows.filter("outlet = 'B'")


@query("WITH @articles SELECT DISTINCT author FROM articles WHERE author IS NOT NULL")
def key_union(spark, d):
    return hy.key_union(*_category_sets(spark, d), "author")


@query(
    """WITH @articles SELECT author FROM articles WHERE outlet = 'A' AND author IS NOT NULL
    INTERSECT SELECT author FROM articles WHERE outlet = 'B'"""
)
def key_intersect(spark, d):
    return hy.key_intersect(*_category_sets(spark, d), "author")


@query(
    """WITH @articles SELECT author FROM articles WHERE outlet = 'A' AND author IS NOT NULL
    EXCEPT SELECT author FROM articles WHERE outlet = 'B'"""
)
def key_except(spark, d):
    return hy.key_except(*_category_sets(spark, d), "author")


@query(
    """SELECT (SELECT count(*) FROM documents) AS expected_rows, (SELECT count(*) FROM labels) AS got_rows,
    (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS keys_not_got,
    (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS keys_not_expected,
    FALSE AS complete"""
)
def coverage_check(spark, d):
    return hy.coverage_check(
        table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id"
    )


@query(
    r"""WITH seg AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*/([^/?#]*)', 1) AS section,
        regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages),
    n AS (SELECT host, count(*) AS n FROM seg GROUP BY host)
    SELECT page_id, CASE WHEN n < 3 AND s.host <> 'www.cheap-pills.example.com' THEN 'other' ELSE s.host END AS host
    FROM seg s JOIN n USING (host)"""
)
def collapse_rare(spark, d):
    hosts = pages(spark, d).select("page_id", urls.host(F.col("url")).alias("host"))
    return hy.collapse_rare(hosts, "host", 3, ["www.cheap-pills.example.com"])

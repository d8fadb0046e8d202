"""Queries: text, URL, date, page and JSON-LD functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from inkwell.functions import dates, pages as pg, text as tx, urls
from inkwell.operators import lexicon as lx
from inkwell.plans.intake import CLEAN_SQL
from inkwell.plans.profiles import CAPS3_SQL, WORDS_SQL
from inkwell.plans.registry import query
from inkwell.plans.views import articles, headlines, pages, table

SQUEEZE_SQL = r"trim(regexp_replace(title, '\s+', ' ', 'g'))"


def _features(spark, d, *families):
    """Only the key and the features: the text column is not carried along."""
    rows = headlines(spark, d).select("doc_id", "title")
    return tx.with_features(rows, "title", *families).drop("title")


def _text(spark, d, **columns):
    return headlines(spark, d).select("doc_id", *[f(F.col("title")).alias(n) for n, f in columns.items()])


@query(f"WITH @headlines SELECT doc_id, {SQUEEZE_SQL} AS text FROM headlines")
def normalize_raw(spark, d):
    return _text(spark, d, text=tx.normalize_raw)


@query(f"WITH @headlines SELECT doc_id, {CLEAN_SQL} AS text_clean FROM headlines")
def clean_strict(spark, d):
    return _text(spark, d, text_clean=tx.clean_strict)


@query(r"""WITH @headlines SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), 'https?://\S+|www\.\S+', ' ', 'g'),
    '[^a-z0-9\-''!?\s]', ' ', 'g'), '\s+', ' ', 'g')) AS text_light FROM headlines""")
def clean_light(spark, d):
    return _text(spark, d, text_light=tx.clean_light)


@query(r"WITH @headlines SELECT doc_id, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS text_lower FROM headlines")
def clean_lower(spark, d):
    return _text(spark, d, text_lower=tx.clean_lower)


@query(f"WITH @headlines SELECT doc_id, {WORDS_SQL} AS word_count, length(title) AS char_count FROM headlines")
def length_features(spark, d):
    return _features(spark, d, tx.length_features)


@query(rf"""WITH @headlines SELECT doc_id, regexp_matches(title, '''[^'']{{1,40}}''')::BIGINT AS has_single_quotes,
    (title LIKE '%?')::BIGINT AS ends_question, contains(title, ':')::BIGINT AS has_colon,
    ({CAPS3_SQL} > 0)::BIGINT AS has_caps3, regexp_matches(title, '^[0-9]')::BIGINT AS starts_with_number,
    {CAPS3_SQL} AS caps3_word_count FROM headlines""")
def eda_flags(spark, d):
    return _features(spark, d, tx.eda_flags)


CAPITAL = r"len([w FOR w IN words IF regexp_matches(w, '^\p{Lu}')])"
ALLCAPS = r"len([w FOR w IN words IF length(w) > 1 AND regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '\p{Ll}')])"
TOKENIZED = r"""@headlines, w AS (SELECT doc_id, title, [w FOR w IN regexp_split_to_array(title, '\s+') IF w <> ''] AS words FROM headlines)"""


@query(rf"""WITH {TOKENIZED} SELECT doc_id, contains(title, '?')::BIGINT AS has_question, contains(title, '!')::BIGINT AS has_exclaim,
    contains(title, ':')::BIGINT AS has_colon, regexp_matches(title, '["‘’“”]')::BIGINT AS has_quote, contains(title, '—')::BIGINT AS has_emdash,
    round({CAPITAL} / greatest(len(words), 1)::DOUBLE, 6) AS cap_word_ratio, round({ALLCAPS} / greatest(len(words), 1)::DOUBLE, 6) AS allcap_word_ratio,
    round(length(regexp_replace(title, '[^0-9]', '', 'g')) / greatest(length(title), 1)::DOUBLE, 6) AS digit_ratio FROM w""")
def style_markers_8(spark, d):
    return _features(spark, d, tx.style_markers_8)


STYLE_16 = rf"""SELECT doc_id, length(title) AS len_chars, len(words) AS n_words,
    round(length(regexp_replace(title, '\s+', '', 'g')) / greatest(len(words), 1)::DOUBLE, 6) AS mean_word_len,
    round({CAPITAL} / greatest(len(words), 1)::DOUBLE, 6) AS caps_word_ratio,
    round({ALLCAPS} / greatest(len(words), 1)::DOUBLE, 6) AS allcaps_word_ratio,
    round(length(regexp_replace(title, '[^0-9]', '', 'g')) / greatest(length(title), 1)::DOUBLE, 6) AS digit_ratio,
    round(length(regexp_replace(title, '[\p{{L}}\p{{N}}\s]', '', 'g')) / greatest(length(title), 1)::DOUBLE, 6) AS punct_ratio,
    contains(title, '?')::BIGINT AS has_question, contains(title, '!')::BIGINT AS has_exclaim, contains(title, ':')::BIGINT AS has_colon,
    length(regexp_replace(title, '[^"‘’“”]', '', 'g')) AS n_quotes, length(regexp_replace(title, '[^—]', '', 'g')) AS n_emdash,
    length(regexp_replace(title, '[^-]', '', 'g')) AS n_hyphen, length(regexp_replace(title, '[^,]', '', 'g')) AS n_comma,
    (title = '' OR regexp_matches(title, '^["‘’“”]'))::BIGINT AS starts_with_quote, (title LIKE '%?')::BIGINT AS ends_with_question FROM w"""
#: The same without rounding, for sums over the features.
STYLE_16_SQL = f"{TOKENIZED}, style AS ({re.sub(r'round[(](.+?), 6[)] AS', r'(\1) AS', STYLE_16)})"
STYLE_16_NAMES = tuple(re.findall(r" AS (\w+)(?=,| FROM)", STYLE_16))


@query(f"WITH {TOKENIZED} {STYLE_16}")
def style_features_16(spark, d):
    return _features(spark, d, tx.style_features_16)


BOUNDED = r"regexp_matches(title, '(?i)(^|[^\p{L}\p{N}_])(%s)([^\p{L}\p{N}_]|$)')::BIGINT"


@query(rf"""WITH {TOKENIZED} SELECT doc_id, (title LIKE '%?')::BIGINT AS ends_question,
    len(regexp_extract_all(title, '''[^'']{{2,30}}''')) AS scare_quote_count, len(regexp_extract_all(title, '\.\.\.')) AS ellipsis_count,
    length(regexp_replace(title, '[^!]', '', 'g')) AS exclamation_count, contains(title, ':')::BIGINT AS has_colon,
    {ALLCAPS} AS allcaps_word_count,
    round(len([w FOR w IN words IF regexp_matches(w, '\p{{Lu}}') AND NOT regexp_matches(w, '[\p{{Lu}}\p{{Ll}}]\p{{Lu}}')
        AND NOT regexp_matches(w, '(^|[^\p{{Lu}}\p{{Ll}}])\p{{Ll}}')]) / greatest(len(words), 1)::DOUBLE, 6) AS title_case_ratio,
    {BOUNDED % 'says?|said'} AS has_says, {BOUNDED % 'reports?|reported'} AS has_report, {BOUNDED % 'sources?'} AS has_sources,
    {BOUNDED % 'allegedly|accused|claims?'} AS has_allegedly, greatest(len(words), 1) AS n_words,
    regexp_matches(title, '^[0-9]')::BIGINT AS starts_with_number,
    round(len(list_distinct(words)) / greatest(len(words), 1)::DOUBLE, 6) AS type_token_ratio FROM w""")
def style_features_18(spark, d):
    return _features(spark, d, tx.style_features_18)


@query(r"""WITH @headlines SELECT doc_id, length(regexp_replace(title, '[^!]', '', 'g')) AS n_exclaim,
    length(regexp_replace(title, '[^?]', '', 'g')) AS n_question, length(regexp_replace(title, '[^"]', '', 'g')) AS n_dquote,
    length(regexp_replace(title, '[^:]', '', 'g')) AS n_colon, length(regexp_replace(title, '[^-]', '', 'g')) AS n_hyphen,
    length(title) AS len_chars FROM headlines""")
def punct_counts_6(spark, d):
    return _features(spark, d, tx.punct_counts_6)


LEXICON = (
    ("the", 0.4), ("is", 1.1), ("with", 1.6), ("and", 0.7), ("not", -1.9), ("was", -0.6),
    ("avec", 1.2), ("pas", -1.4), ("nicht", -1.7), ("und", 0.5), ("para", 0.9), ("pero", -0.8),
)
GAZETTEER = (
    ("The", "ORG"), ("And", "PERSON"), ("Der", "GPE"), ("La", "NORP"), ("The and", "PERSON"),
    ("Of the", "GPE"), ("Is", "PERSON"), ("Die", "ORG"), ("Para", "GPE"), ("Les", "EVENT"),
)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" for v in r) + ")" for r in rows)


SENTIMENT_SQL = rf"""lexicon AS (SELECT * FROM (VALUES {_values(LEXICON)}) AS v(token, valence)),
    tok AS (SELECT doc_id, unnest([regexp_replace(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '')
        FOR w IN regexp_split_to_array(lower(title), '\s+')]) AS token FROM articles),
    v AS (SELECT doc_id, coalesce(valence, 0) AS v FROM (SELECT * FROM tok WHERE token <> '') t LEFT JOIN lexicon USING (token)),
    s AS (SELECT a.doc_id, coalesce(sum(v), 0) AS s, coalesce(sum(v + 1) FILTER (v > 0), 0) AS p, coalesce(sum(1 - v) FILTER (v < 0), 0) AS n,
        count(v) FILTER (v = 0) AS z FROM articles a LEFT JOIN v ON v.doc_id = a.doc_id GROUP BY a.doc_id),
    sentiment AS (SELECT doc_id, s / sqrt(s * s + 15) AS compound, coalesce(n / nullif(p + n + z, 0), 0) AS neg,
        coalesce(p / nullif(p + n + z, 0), 0) AS pos, coalesce(z / nullif(p + n + z, 0), 0) AS neu FROM s)"""


@query(f"""WITH @articles, {SENTIMENT_SQL}
    SELECT doc_id, round(compound, 6) + 0.0 AS compound, round(neg, 6) AS neg, round(pos, 6) AS pos, round(neu, 6) AS neu FROM sentiment""")
def lexicon_sentiment(spark, d):
    lexicon = spark.createDataFrame(list(LEXICON), "token string, valence double")
    return lx.lexicon_sentiment(headlines(spark, d), "doc_id", "title", lexicon)


@query(f"""WITH @articles, {SENTIMENT_SQL}
    SELECT topic, outlet, count(*) AS n, round(avg(compound), 6) + 0.0 AS mean_compound
    FROM articles JOIN sentiment USING (doc_id) WHERE topic IS NOT NULL GROUP BY topic, outlet HAVING count(*) >= 5""")
def sentiment_by(spark, d):
    lexicon = spark.createDataFrame(list(LEXICON), "token string, valence double")
    df = articles(spark, d)
    scored = lx.lexicon_sentiment(df, "doc_id", "title", lexicon)
    return lx.sentiment_by(df.select("doc_id", "topic", "outlet").join(scored, "doc_id"), ["topic", "outlet"], 5)


@query("""WITH @articles SELECT author, outlet, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY author), 6) AS share
    FROM articles WHERE author IS NOT NULL GROUP BY author, outlet""")
def author_bias(spark, d):
    return lx.author_bias(articles(spark, d), "author", "outlet")


ENTITY_SQL = rf"""@headlines, gaz AS (SELECT * FROM (VALUES {_values(GAZETTEER)}) AS v(phrase, type)),
    t AS (SELECT doc_id, [x FOR x IN [regexp_replace(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '')
        FOR w IN regexp_split_to_array(title, '\s+')] IF x <> ''] AS ws FROM headlines),
    g AS (SELECT doc_id, unnest(ws) AS phrase FROM t
        UNION ALL SELECT doc_id, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) FROM t),
    hit AS (SELECT doc_id, type FROM g JOIN gaz USING (phrase)),
    ents AS (SELECT h.doc_id, count(type) FILTER (type = 'PERSON') AS person_count, count(type) FILTER (type = 'ORG') AS org_count,
        count(type) FILTER (type = 'GPE') AS gpe_count, count(type) FILTER (type = 'NORP') AS norp_count, count(type) AS total_ents
        FROM headlines h LEFT JOIN hit ON hit.doc_id = h.doc_id GROUP BY h.doc_id)"""


def _entities(spark, d):
    gazetteer = spark.createDataFrame(list(GAZETTEER), "phrase string, type string")
    return lx.entity_counts(headlines(spark, d), "doc_id", "title", gazetteer, 2)


@query(f"""WITH {ENTITY_SQL} SELECT *, round(person_count / greatest(total_ents, 1)::DOUBLE, 6) AS person_to_ent_ratio,
    round(org_count / greatest(total_ents, 1)::DOUBLE, 6) AS org_to_ent_ratio FROM ents""")
def entity_counts(spark, d):
    return _entities(spark, d)


@query(rf"""WITH {ENTITY_SQL}, w AS (SELECT doc_id, title, [x FOR x IN regexp_split_to_array(title, '\s+') IF x <> ''] AS words FROM headlines)
    SELECT doc_id, contains(title, ':')::BIGINT AS has_colon, regexp_matches(title, '^[0-9]')::BIGINT AS starts_with_number,
        greatest(len(words), 1) AS n_words, length(title) AS char_count, (title LIKE '%?')::BIGINT AS ends_question,
        {ALLCAPS} AS allcaps_word_count, round(person_count / greatest(total_ents, 1)::DOUBLE, 6) AS person_to_ent_ratio
    FROM w JOIN ents USING (doc_id)""")
def style_selected_7(spark, d):
    return _features(spark, d, lambda t: tx.style_selected(t, 7)).join(
        _entities(spark, d).select("doc_id", "person_to_ent_ratio"), "doc_id"
    )


@query(rf"""WITH @headlines SELECT doc_id, {WORDS_SQL} AS word_count, length(title) AS char_count,
    regexp_matches(title, '''[^'']{{1,40}}''')::BIGINT AS has_single_quotes, (title LIKE '%?')::BIGINT AS ends_question,
    contains(title, ':')::BIGINT AS has_colon, ({CAPS3_SQL} > 0)::BIGINT AS has_caps3 FROM headlines""")
def style_selected_6(spark, d):
    return _features(spark, d, lambda t: tx.style_selected(t, 6))


@query(rf"""WITH {ENTITY_SQL}, w AS (SELECT doc_id, title, [x FOR x IN regexp_split_to_array(title, '\s+') IF x <> ''] AS words FROM headlines)
    SELECT doc_id, greatest(len(words), 1) AS n_words, len(regexp_extract_all(title, '''[^'']{{2,30}}''')) AS scare_quote_count,
        contains(title, ':')::BIGINT AS has_colon, round(person_count / greatest(total_ents, 1)::DOUBLE, 6) AS person_to_ent_ratio, person_count
    FROM w JOIN ents USING (doc_id)""")
def style_selected_5(spark, d):
    return _features(spark, d, lambda t: tx.style_selected(t, 5)).join(
        _entities(spark, d).select("doc_id", "person_to_ent_ratio", "person_count"), "doc_id"
    )


@query(rf"""WITH @headlines SELECT doc_id, regexp_replace({CLEAN_SQL}, '(ing|tions?|ments?|edly|ness|ly|ed|es|s)\b', '', 'g') AS stemmed FROM headlines""",
       name="stem")
def stem_query(spark, d):
    return _text(spark, d, stemmed=lambda t: tx.stem(tx.clean_strict(t)))


@query(rf"""WITH @headlines SELECT doc_id, CASE WHEN {SQUEEZE_SQL} = '' THEN '(none)' WHEN length({SQUEEZE_SQL}) <= 200 THEN {SQUEEZE_SQL}
    ELSE left({SQUEEZE_SQL}, 199) || '…' END AS preview FROM headlines""")
def preview(spark, d):
    return _text(spark, d, preview=tx.preview)


PATH_SQL = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
SEGMENTS_SQL = f"[s FOR s IN string_split({PATH_SQL}, '/') IF s <> '']"


@query(rf"""SELECT page_id, coalesce(translate([s FOR s IN {SEGMENTS_SQL} IF regexp_matches(s, '\p{{L}}')][-1], '-_', '  '), '') AS slug FROM pages""")
def slug_text(spark, d):
    return pages(spark, d).select("page_id", urls.slug_text(F.col("url")).alias("slug"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '\.print$', '') AS url,
    lower(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '/+$', '')) AS match_key FROM pages""")
def normalize_url(spark, d):
    url = F.col("url")
    return pages(spark, d).select("page_id", urls.normalize_url(url).alias("url"), urls.url_match_key(url).alias("match_key"))


@query(rf"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]*/[^/?#]*)', 1) AS parent,
        replace(url, '://www.', '://') AS other FROM pages)
    SELECT page_id, TRUE AS with_parent, NOT contains(url, '://www.') AS with_other FROM u""")
def urls_same_story(spark, d):
    url = F.col("url")
    parent = F.regexp_extract(url, r"^(https?://[^/?#]*/[^/?#]*)", 1)
    other = F.replace(url, F.lit("://www."), F.lit("://"))
    return pages(spark, d).select(
        "page_id", urls.urls_same_story(url, parent).alias("with_parent"), urls.urls_same_story(url, other).alias("with_other")
    )


@query(f"SELECT page_id, lower({SEGMENTS_SQL}[1]) AS section FROM pages")
def section_from_url(spark, d):
    return pages(spark, d).select("page_id", urls.section_from_url(F.col("url")).alias("section"))


@query(f"""SELECT page_id, CASE WHEN {SEGMENTS_SQL}[1] = 'en' THEN coalesce({SEGMENTS_SQL}[2], 'other') ELSE coalesce({SEGMENTS_SQL}[1], 'other') END AS category FROM pages""")
def category(spark, d):
    return pages(spark, d).select("page_id", urls.category(F.col("url"), "en").alias("category"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN date_trunc('day', ts) WHEN 'click' THEN ts - INTERVAL 2 HOUR
    WHEN 'signup' THEN date_trunc('minute', ts) ELSE ts END AS parsed FROM events""")
def parse_ts(spark, d):
    """Event times written in five ways, one of them unreadable, and read back."""
    ts = F.col("ts")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    written = (
        F.when(F.col("event_type") == "error", "posted recently")
        .when(F.col("event_type") == "view", F.date_format(ts, "yyyy-MM-dd"))
        .when(F.col("event_type") == "click", F.concat(iso, F.lit("+02:00")))
        .when(F.col("event_type") == "signup", F.date_format(ts, "MMMM d, yyyy h:mm a"))
        .otherwise(F.concat(iso, F.lit("Z")))
    )
    return table(spark, d, "events").select("event_id", dates.parse_ts(written).alias("parsed"))


@query("""SELECT event_id, ts::DATE AS date, date_trunc('month', ts)::DATE AS month, hour(ts) AS hour, dayname(ts) AS day_name, year(ts) AS year FROM events""")
def calendar_parts(spark, d):
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in dates.calendar_parts(F.col("ts")).items()])


@query(r"""SELECT page_id, trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&')) AS title,
    trim(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&')) AS h1,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS page_lang, lower(regexp_extract(url, '^https?://[^/]*/([^/?#]*)', 1)) AS section FROM pages""")
def page_fields(spark, d):
    return pg.page_fields(pages(spark, d)).select("page_id", "title", "h1", "page_lang", "section")


@query()
def first_paragraph(spark, d):
    return pg.first_paragraph(pages(spark, d), "page_id")


def _pages_with_jsonld(spark, d):
    """The given pages with JSON-LD scripts written from their own url and title."""
    story = F.regexp_replace("url", "[#?].*$", "")
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    article = F.struct(
        F.lit("NewsArticle").alias("@type"), story.alias("url"), title.alias("headline"),
        F.struct(F.concat(F.lit(" Desk "), F.col("page_id").cast("string")).alias("name")).alias("author"),
        F.lit("2024-03-01T10:00:00Z").alias("datePublished"),
    )
    live = F.struct(
        F.array(F.lit("LiveBlogPosting"), F.lit("Thing")).alias("@type"),
        F.struct(F.concat(story, F.lit("#live")).alias("@id")).alias("mainEntityOfPage"),
        F.concat(F.lit("Live: "), title).alias("headline"),
    )
    video = F.to_json(F.struct(F.lit("VideoObject").alias("@type"), F.lit("https://video.example/v").alias("url")))
    graph = F.concat(F.lit('{"@graph": ['), F.to_json(live), F.lit(", "), video, F.lit(', "junk"]}'))
    listed = F.concat(F.lit("["), video, F.lit(", "), F.to_json(article), F.lit("]"))
    body = F.when(F.col("url").contains("?"), graph).when(F.col("url").contains("#"), listed).otherwise(F.to_json(article))
    wrap = lambda s: F.concat(F.lit('<script type="application/ld+json">'), s, F.lit("</script>"))
    return pages(spark, d).withColumn("html", F.concat("html", wrap(F.lit("{broken")), wrap(body)))


JSONLD_SQL = r"""story AS (SELECT page_id, url, regexp_replace(url, '[#?].*$', '') AS story,
    regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)"""


@query(f"""WITH {JSONLD_SQL} SELECT page_id, CASE WHEN contains(url, '?') THEN 'LiveBlogPosting,Thing' ELSE 'NewsArticle' END AS types,
    story AS entity_url, CASE WHEN contains(url, '?') THEN 1000000 WHEN contains(url, '#') THEN 1000001 ELSE 1000000 END::BIGINT AS position FROM story""")
def jsonld_entities(spark, d):
    found = pg.jsonld_entities(_pages_with_jsonld(spark, d), "page_id")
    return found.select("page_id", F.array_join("types", ",").alias("types"), "entity_url", "position")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'Ann ' || user_id WHEN 'view' THEN 'user ' || user_id
    WHEN 'purchase' THEN 'A' || user_id || ', desk' END AS author FROM events""")
def author_string(spark, d):
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    written = (
        F.when(kind == "click", F.concat(F.lit('"  Ann '), user, F.lit(' "')))
        .when(kind == "view", F.concat(F.lit('{"name": "user '), user, F.lit('"}')))
        .when(kind == "purchase", F.concat(F.lit('[{"name": "A'), user, F.lit('"}, "desk", {"x": 1}, ""]')))
        .when(kind == "signup", F.lit("[]"))
    )
    return table(spark, d, "events").select("event_id", pg.author_string(F.try_parse_json(written)).alias("author"))


@query(f"""WITH {JSONLD_SQL} SELECT page_id, 'title' AS field, CASE WHEN contains(url, '?') THEN 'LiveBlogPosting' ELSE 'NewsArticle' END AS origin,
        trim(CASE WHEN contains(url, '?') THEN 'Live: ' || title ELSE title END) AS value FROM story
    UNION ALL SELECT page_id, 'author', 'NewsArticle', 'Desk ' || page_id FROM story WHERE NOT contains(url, '?')
    UNION ALL SELECT page_id, 'datetime_posted', 'NewsArticle', '2024-03-01T10:00:00Z' FROM story WHERE NOT contains(url, '?')
    UNION ALL SELECT page_id, 'topic', 'url', lower(regexp_extract(url, '^https?://[^/]*/([^/?#]*)', 1)) FROM story""")
def resolve_fields(spark, d):
    from_pages = _pages_with_jsonld(spark, d)
    offers = pg.jsonld_candidates(pg.jsonld_entities(from_pages, "page_id"), "page_id")
    head = pg.page_fields(pages(spark, d))
    tags = F.array(
        F.struct(F.lit("title").alias("field"), F.lit("title tag").alias("origin"), F.col("title").alias("value")),
        F.struct(F.lit("topic").alias("field"), F.lit("url").alias("origin"), F.col("section").alias("value")),
    )
    fallback = head.select("page_id", F.inline(tags)).filter("value is not null").withColumn("position", F.lit(0).cast("bigint"))
    order = {
        "title": [*pg.TYPE_ORDER, "title tag"], "author": pg.TYPE_ORDER, "datetime_posted": pg.TYPE_ORDER, "topic": ["url"],
    }
    return pg.resolve_fields(offers.unionByName(fallback), "page_id", order)

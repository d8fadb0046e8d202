"""Fields of stored pages: head tags, body paths, JSON-LD, field priority."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, functions as F, types as T

from inkwell.functions.text import squeeze, strip, unescape
from inkwell.functions.urls import section_from_url, urls_same_story

# Tags without content, and the page types in order of preference.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta source track wbr".split()
)
TYPE_ORDER = ("LiveBlogPosting", "NewsArticle", "BlogPosting")


def _inner(html: Column, tag: str) -> Column:
    body = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return F.nullif(squeeze(unescape(F.regexp_replace(body, r"(?s)<[^>]*>", ""))), F.lit(""))


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 1)
    single = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 2)
    return F.nullif(F.concat(quoted, single), F.lit(""))


def meta_tags(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), 1)


def meta_content(tags: Column, key: str) -> Column:
    """``content`` of the first meta tag whose ``name`` or else ``property`` is ``key``."""
    by_name = F.filter(tags, lambda t: _attribute(t, "name") == key)
    by_property = F.filter(tags, lambda t: _attribute(t, "property") == key)
    found = F.coalesce(F.get(by_name, F.lit(0)), F.get(by_property, F.lit(0)))
    return F.nullif(strip(unescape(_attribute(found, "content"))), F.lit(""))


def page_fields(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Head and heading fields of every stored page, on built-in expressions."""
    html, url, metas = F.col(html_col), F.col(url_col), F.col("_metas")
    time_tag = F.regexp_extract(html, r"(?is)(<time\b[^>]*>)", 1)
    return pages.withColumn("_metas", meta_tags(html)).withColumns(
        {
            "title": _inner(html, "title"),
            "h1": _inner(html, "h1"),
            "h2": _inner(html, "h2"),
            "page_lang": _attribute(F.regexp_extract(html, r"(?is)(<html\b[^>]*>)", 1), "lang"),
            "description": meta_content(metas, "description"),
            "og_title": meta_content(metas, "og:title"),
            "og_description": meta_content(metas, "og:description"),
            "published_time": meta_content(metas, "article:published_time"),
            "section": F.coalesce(meta_content(metas, "prism.section"), section_from_url(url)),
            "time": _attribute(time_tag, "datetime"),
        }
    ).drop("_metas")


class _FirstMatch(HTMLParser):
    """Text of the first element that satisfies each wanted ``(name, class, scope)``."""

    def __init__(self, wanted: dict[str, tuple[str, str | None, str | None]]):
        super().__init__(convert_charrefs=True)
        self.wanted, self.stack, self.texts = wanted, [], {}

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        classes = (dict(attrs).get("class") or "").split()
        opened = []
        for field, (name, css, scope) in self.wanted.items():
            inside = scope is None or any(t == scope for t, _ in self.stack)
            if field not in self.texts and tag == name and inside:
                if css is None or css in classes:
                    self.texts[field] = []
                    opened.append(field)
        self.stack.append((tag, opened))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        for _, fields in self.stack:
            for field in fields:
                if data.strip():
                    self.texts[field].append(data.strip())


def body_fields(
    pages: DataFrame,
    key_col: str,
    wanted: dict[str, tuple[str, str | None, str | None]],
    html_col: str = "html",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(key, *wanted, *keep)`` from body paths a pattern cannot follow (nested tags).

    ``wanted`` maps a field to ``(tag, class or None, enclosing tag or None)``.
    """
    fields = T.StructType([T.StructField(f, T.StringType()) for f in wanted])

    # a plain function gets a hundred pages at a time; Arrow batches hold up to ten thousand whole pages
    @F.udf(fields, useArrow=False)
    def parsed(html: str | None) -> tuple:
        found = _FirstMatch(wanted)
        found.feed(html or "")
        found.close()
        return tuple(" ".join(found.texts.get(f, [])) or None for f in wanted)

    found = pages.select(key_col, parsed(html_col).alias("_found"), *keep)
    return found.select(key_col, *[F.col("_found")[f].alias(f) for f in wanted], *keep)


def first_paragraph(pages: DataFrame, key_col: str, html_col: str = "html") -> DataFrame:
    """First ``<p>`` of the article, else of the body, else anywhere."""
    marked = pages.withColumn("_has_article", F.col(html_col).rlike(r"(?is)<article\b"))
    wanted = {"_a": ("p", None, "article"), "_b": ("p", None, "body"), "_p": ("p", None, None)}
    found = body_fields(marked, key_col, wanted, html_col, keep=["_has_article"])
    paragraph = F.when(F.col("_has_article"), F.col("_a")).otherwise(F.coalesce("_b", "_p"))
    return found.select(key_col, paragraph.alias("first_paragraph"))


def _text_at(value: Column, path: str) -> Column:
    """String at ``path`` of a variant; NULL when it is another type or blank."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    text = F.try_variant_get(value, path, "string")
    return F.when(kind == "STRING", F.nullif(strip(text), F.lit("")))


def author_string(value: Column) -> Column:
    """Name(s) of a schema.org author: text, object, or list of either; blank is NULL."""
    kind = F.schema_of_variant(value)

    def one(entry: Column) -> Column:
        return F.coalesce(
            _text_at(entry, "$"), F.nullif(strip(F.try_variant_get(entry, "$.name", "string")), F.lit(""))
        )

    listed = F.filter(
        F.transform(F.try_variant_get(value, "$", "array<variant>"), one), lambda n: n.isNotNull()
    )
    return F.when(
        kind.startswith("ARRAY"), F.nullif(F.array_join(listed, ", "), F.lit(""))
    ).otherwise(one(value))


def branch_authors(html: Column, prefix: str = "branch:deeplink:authorName") -> Column:
    """Numbered author metas joined in order, up to the first missing number.

    Of tags with one number the first in the page counts.
    """
    named = F.filter(meta_tags(html), lambda t: F.startswith(_attribute(t, "name"), F.lit(prefix)))
    numbered = F.transform(
        named,
        lambda t, i: F.struct(
            F.substring(_attribute(t, "name"), len(prefix) + 1, 9).try_cast("int").alias("n"),
            i.alias("place"),
            F.coalesce(strip(unescape_entities(_attribute(t, "content"))), F.lit("")).alias("name"),
        ),
    )
    ordered = F.array_sort(F.filter(numbered, lambda s: s["n"].isNotNull()))
    unique = F.filter(ordered, lambda s, i: (i == 0) | (F.get(ordered, i - 1)["n"] != s["n"]))
    in_run = F.filter(unique, lambda s, i: s["n"] == i + 1)
    names = F.filter(F.transform(in_run, lambda s: s["name"]), lambda n: n != "")
    return F.nullif(F.array_join(names, ", "), F.lit(""))


def unescape_entities(text: Column) -> Column:
    """The five XML entities, natively (usable inside higher-order functions)."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def jsonld_entities(
    pages: DataFrame, key_col: str, html_col: str = "html", url_col: str = "url",
    same_story: bool = True,
) -> DataFrame:
    """One row per JSON-LD object of a page: ``position, entity, types, entity_url``.

    Objects come from the top level, from list items and from ``@graph``;
    scripts that are not valid JSON are skipped.  With ``same_story`` only
    objects whose URL belongs to the page remain.
    """
    script = r"(?is)<script\b[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"
    scripts = pages.select(
        key_col, url_col, F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(script), 1)).alias("_script", "_json")
    ).withColumn("_root", F.try_parse_json("_json"))
    root_kind = F.schema_of_variant("_root")
    graph = F.try_variant_get("_root", "$['@graph']", "array<variant>")
    objects = (
        F.when(root_kind.startswith("ARRAY"), F.try_variant_get("_root", "$", "array<variant>"))
        .when(F.exists(graph, lambda v: F.schema_of_variant(v).startswith("OBJECT")), graph)
        .otherwise(F.array("_root"))
    )
    entities = (
        scripts.filter(F.col("_root").isNotNull())
        .select(key_col, url_col, "_script", F.posexplode(objects).alias("_item", "entity"))
        .filter(F.schema_of_variant("entity").startswith("OBJECT"))
    )
    entity = F.col("entity")
    typed = F.try_variant_get(entity, "$['@type']", "variant")
    types = (
        F.when(F.schema_of_variant(typed) == "STRING", F.array(F.try_variant_get(typed, "$", "string")))
        .when(
            F.schema_of_variant(typed).startswith("ARRAY"),
            F.filter(F.try_variant_get(typed, "$", "array<string>"), lambda t: t.isNotNull()),
        )
        .otherwise(F.array().cast("array<string>"))
    )
    page_id = F.regexp_replace(_text_at(entity, "$.mainEntityOfPage['@id']"), r"(?s)#.*$", "")
    out = entities.withColumns(
        {
            "position": F.col("_script").cast("bigint") * 1_000_000 + F.col("_item"),
            "types": types,
            "entity_url": F.coalesce(_text_at(entity, "$.url"), page_id),
        }
    ).drop("_script", "_item")
    if same_story:
        out = out.filter(urls_same_story(F.col(url_col), F.col("entity_url")))
    return out


def jsonld_candidates(entities: DataFrame, key_col: str) -> DataFrame:
    """``(key, field, origin, position, value)`` offers made by JSON-LD objects."""
    entity = F.col("entity")
    fields = {
        "title": F.coalesce(_text_at(entity, "$.headline"), _text_at(entity, "$.alternativeHeadline")),
        "subtitle": _text_at(entity, "$.description"),
        "author": author_string(F.try_variant_get(entity, "$.author", "variant")),
        "datetime_posted": F.coalesce(
            *[_text_at(entity, f"$.{k}") for k in ("datePublished", "dateModified", "coverageStartTime")]
        ),
    }
    offers = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()])
    known = F.filter(
        F.array(*[F.lit(t) for t in TYPE_ORDER]), lambda t: F.array_contains(F.col("types"), t)
    )
    return (
        entities.withColumn("origin", F.get(known, F.lit(0)))
        .filter(F.col("origin").isNotNull())
        .select(key_col, "origin", "position", F.inline(offers))
        .filter(F.col("value").isNotNull())
    )


def resolve_fields(
    candidates: DataFrame,
    key_col: str,
    priority: Sequence[str] | dict[str, Sequence[str]],
) -> DataFrame:
    """First non-blank value per (key, field) by origin priority, then position.

    ``candidates``: ``(key, field, origin, position, value)``.  ``priority`` is one
    order of origins, or one order per field.
    """
    if isinstance(priority, dict):
        rank = F
        for field, order in priority.items():
            for place, origin in enumerate(order):
                rank = rank.when((F.col("field") == field) & (F.col("origin") == origin), place)
        rank = rank.otherwise(None)
    else:
        rank = F
        for place, origin in enumerate(priority):
            rank = rank.when(F.col("origin") == origin, place)
        rank = rank.otherwise(None)
    ranked = candidates.withColumn("_rank", rank).filter(
        F.col("_rank").isNotNull() & (strip(F.col("value")) != "")
    )
    best = F.min(F.struct("_rank", "position", "origin", strip(F.col("value")).alias("value")))
    return (
        ranked.groupBy(key_col, "field").agg(best.alias("_best"))
        .select(key_col, "field", "_best.origin", "_best.value")
    )

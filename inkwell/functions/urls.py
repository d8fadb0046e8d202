"""URL expressions: keys, sections, categories, page kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from inkwell.functions.text import strip

# Limits above which a path segment is a slug, not a category.
MAX_CATEGORY_CHARS = 40
MAX_CATEGORY_HYPHENS = 5
LIVE_MARKS = ("/live-blog/", "/live-news/")


def _path(url: Column) -> Column:
    """Path part by pattern; unlike a strict URI parser it accepts any junk."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def segments(url: Column) -> Column:
    return F.filter(F.split(_path(url), "/"), lambda s: s != "")


def drop_fragment(url: Column) -> Column:
    return F.regexp_replace(strip(url), r"(?s)#.*$", "")


def normalize_url(url: Column) -> Column:
    """Without surrounding space, fragment and the ``.print`` suffix."""
    return F.regexp_replace(drop_fragment(url), r"\.print$", "")


def url_match_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(drop_fragment(url), r"/+$", ""))


def urls_same_story(page_url: Column, entity_url: Column) -> Column:
    """Equal keys, or same host and the entity path is the page path or a parent of it."""
    page, entity = drop_fragment(F.lower(page_url)), drop_fragment(F.lower(entity_url))
    page_path = F.regexp_replace(_path(page), r"/+$", "")
    entity_path = F.regexp_replace(_path(entity), r"/+$", "")
    below = page_path.startswith(F.concat(entity_path, F.lit("/"))) | (page_path == entity_path)
    same = (url_match_key(page_url) == url_match_key(entity_url)) | (
        (host(page) == host(entity)) & (entity_path != "") & below
    )
    return F.coalesce(same & (entity_url != ""), F.lit(False))


def slug_text(url: Column) -> Column:
    """Last path segment holding a letter, with ``-`` and ``_`` as blanks."""
    lettered = F.filter(segments(url), lambda s: s.rlike(r"\p{L}"))
    return F.when(
        F.size(lettered) > 0, F.translate(F.element_at(lettered, -1), "-_", "  ")
    ).otherwise(F.lit(""))


def looks_like_url(value: Column) -> Column:
    return F.lower(value).rlike(r"^(https?://|www\.)")


def section_from_url(url: Column) -> Column:
    return F.nullif(F.lower(strip(F.get(segments(url), F.lit(0)))), F.lit(""))


def category(url: Column, second_after: str | None = "news") -> Column:
    """First path segment, or the second one below ``second_after``; slugs become ``other``."""
    parts = segments(url)
    found = F.get(parts, F.lit(0))
    if second_after is not None:
        found = F.when(found == second_after, F.get(parts, F.lit(1))).otherwise(found)
    hyphens = F.length(found) - F.length(F.replace(found, F.lit("-"), F.lit("")))
    slug = (F.length(found) > MAX_CATEGORY_CHARS) | (hyphens > MAX_CATEGORY_HYPHENS)
    return F.when(found.isNull() | slug, F.lit("other")).otherwise(found)


def page_kind(url: Column, live_marks: Sequence[str] = LIVE_MARKS) -> Column:
    path = F.lower(_path(url))
    live = F.lit(False)
    for mark in live_marks:
        live = live | path.contains(mark)
    return F.when(live, F.lit("live")).otherwise(F.lit("article"))


def partition_by_host(url: Column, rules: dict[str, str]) -> Column:
    """Name of the first rule whose host substring occurs in the URL, else ``other``."""
    routed = F
    for name, fragment in rules.items():
        routed = routed.when(F.lower(url).contains(fragment), F.lit(name))
    return routed.otherwise(F.lit("other"))


def label_from_url(url: Column, rules: dict[int, dict[str, Sequence[str]]]) -> Column:
    """0/1/NULL from ``{label: {"contains": [...], "prefix": [...]}}``; first label wins."""
    lowered, label = F.lower(url), F
    for value, rule in rules.items():
        hit = F.lit(False)
        for part in rule.get("contains", ()):
            hit = hit | lowered.contains(part)
        for part in rule.get("prefix", ()):
            hit = hit | lowered.startswith(part)
        label = label.when(hit, F.lit(value))
    return label.otherwise(F.lit(None).cast("int"))

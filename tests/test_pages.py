import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from inkwell.functions import dates, pages as pg, urls


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "page, entity, want",
    [
        ("https://a.com/x/y#1", "https://A.com/x/y/", True),
        ("https://a.com/x/card?canonicalCard=1", "https://a.com/x", True),
        ("https://a.com/xy", "https://a.com/x", False),
        ("https://a.com/x", "https://b.com/x", False),
        ("https://a.com/x", "https://a.com/", False),
        ("https://a.com/x", None, False),
    ],
)
def test_urls_same_story(spark, page, entity, want):
    df = spark.createDataFrame([(page, entity)], "p string, e string")
    assert df.select(urls.urls_same_story(F.col("p"), F.col("e"))).first()[0] is want


def test_url_functions(spark):
    assert one(spark, " https://a.com/b/c.print#top ", urls.normalize_url) == "https://a.com/b/c.print".removesuffix(".print")
    assert one(spark, "https://a.com/News/x", urls.section_from_url) == "news"
    assert one(spark, "https://a.com/", urls.section_from_url) is None
    assert one(spark, "https://a.com/news/world/x", urls.category) == "world"
    assert one(spark, "https://a.com/a-b-c-d-e-f-g/x", urls.category) == "other"
    assert one(spark, "https://a.com/politics/some-big_story/123", urls.slug_text) == "some big story"
    assert one(spark, "https://a.com/Live-Blog/x", urls.page_kind) == "live"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2024-01-02T03:04:05+02:00", dt.datetime(2024, 1, 2, 1, 4, 5)),
        ("2024-01-02T03:04:05.5Z", dt.datetime(2024, 1, 2, 3, 4, 5, 500000)),
        ("2024-01-02", dt.datetime(2024, 1, 2)), ("January 3, 2024 4:05 PM", dt.datetime(2024, 1, 3, 16, 5)),
        ("Tue, 02 Jan 2024 03:04:05 -0500", dt.datetime(2024, 1, 2, 8, 4, 5)),
        ("garbage", None), ("2024-13-45", None), (None, None),
    ],
)
def test_parse_ts(spark, raw, want):
    assert one(spark, raw, dates.parse_ts) == want


def test_parse_ts_strict_fails(spark):
    with pytest.raises(Exception, match="unreadable"):
        one(spark, "garbage", lambda t: dates.parse_ts(t, strict=True))


PAGE = """<html lang="en"><head><title>T &amp; U</title><meta content='Desc' name="description">
<meta property="og:title" content="OG"><meta name="branch:deeplink:authorName1" content="Ann">
<meta name="branch:deeplink:authorName2" content=" "><meta name="branch:deeplink:authorName3" content="Bob">
<meta name="branch:deeplink:authorName5" content="Eve"></head>
<body><p>outside</p><article><div class="author-byline"><a>By Cy</a></div><h1 class="headline speakable">Big <i>news</i></h1>
<p>First <b>bold<br> text</b></p><p>second</p><time datetime="2024-05-01T00:00:00Z">x</time></article></body></html>"""


def test_page_fields(spark):
    df = spark.createDataFrame([(1, "https://a.com/world/x", PAGE)], "page_id int, url string, html string")
    got = pg.page_fields(df).first().asDict()
    assert got["title"] == "T & U" and got["h1"] == "Big news" and got["description"] == "Desc"
    assert got["og_title"] == "OG" and got["section"] == "world" and got["time"] == "2024-05-01T00:00:00Z"
    assert pg.first_paragraph(df, "page_id").first()["first_paragraph"] == "First bold text"
    body = pg.body_fields(df, "page_id", {"byline": ("div", "author-byline", None), "none": ("h2", None, None)}).first()
    assert body["byline"] == "By Cy" and body["none"] is None
    assert df.select(pg.branch_authors(F.col("html"))).first()[0] == "Ann, Bob"


@pytest.mark.parametrize(
    "author, want",
    [
        (" Ann ", "Ann"), ({"name": "Bob"}, "Bob"), ([{"name": "A"}, "B", {"x": 1}, " "], "A, B"), ([], None), ({}, None), ("", None),
    ],
)
def test_author_string(spark, author, want):
    assert one(spark, json.dumps(author), lambda t: pg.author_string(F.try_parse_json(t))) == want


def test_jsonld_and_priority(spark):
    url = "https://a.com/x"
    scripts = [
        "{bad",
        json.dumps([{"@type": "NewsArticle", "url": url, "headline": "News", "datePublished": "2024-01-01"}, 3]),
        json.dumps({"@graph": [{"@type": ["LiveBlogPosting"], "mainEntityOfPage": {"@id": url + "#f"}, "headline": "Live", "author": "Ann"}]}),
        json.dumps({"@type": "NewsArticle", "url": "https://b.com/x", "headline": "Elsewhere"}),
    ]
    html = "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)
    df = spark.createDataFrame([(1, url + "/card?x=1", html)], "page_id int, url string, html string")
    offers = pg.jsonld_candidates(pg.jsonld_entities(df, "page_id"), "page_id")
    got = {r["field"]: r["value"] for r in pg.resolve_fields(offers, "page_id", pg.TYPE_ORDER).collect()}
    assert got == {"title": "Live", "author": "Ann", "datetime_posted": "2024-01-01"}


def test_pages_reach_python_in_small_batches(spark):
    """Whole pages are parsed a hundred at a time, not in Arrow batches of up to ten thousand."""
    rows = [(i, f"<html><body><p>a{i}</p><article><p>b <i>{i}</i></p></article></body></html>") for i in range(5)] + [(5, None), (5, "<p>x"), (None, "<body><p> </p><p>y</p>")]
    found = pg.first_paragraph(spark.createDataFrame(rows, "page_id int, html string"), "page_id")
    got = sorted(((r["page_id"], r["first_paragraph"]) for r in found.collect()), key=str)
    assert got == sorted([*((i, f"b {i}") for i in range(5)), (5, None), (5, "x"), (None, None)], key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "MapInPandas" not in plan and "Arrow" not in plan

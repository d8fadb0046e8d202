"""Main text against pages built from known articles in many layouts, and odd markup."""

import random
import time

import pytest

from inkwell.llm import page_text as pt

WORDS = "the river ran past old mills while people of a small town met on market days to trade wool bread news and songs".split()


def sentence(rnd, low=6, high=24):
    return " ".join(rnd.choices(WORDS, k=rnd.randrange(low, high))).capitalize() + "."


def paragraph(rnd):
    return " ".join(sentence(rnd) for _ in range(rnd.randrange(1, 7)))


def links(rnd, n):
    return "".join(f'<li><a href="/{k}">{rnd.choice(WORDS)} {rnd.choice(WORDS)}</a></li>' for k in range(n))


FRAMES = {
    "article": "<article>{}</article>",
    "main": '<main id="content">{}</main>',
    "divs": '<div class="page"><div class="content"><div class="entry">{}</div></div></div>',
    "sections": '<div id="wrap"><div id="text">{}</div></div>',
    "table": '<table><tr><td width="20%"><ul>{nav}</ul></td><td>{}</td></tr></table>',
    "turned": '<div class="layout has-sidebar"><article class="post">{}</article></div>',
    "wrapper": '<div class="page-menu-wrapper"><main>{}</main></div>',
}


def page(rnd, frame):
    title = sentence(rnd, 3, 8)
    texts = [paragraph(rnd) for _ in range(rnd.randrange(4, 12))]
    texts[rnd.randrange(len(texts))] = "Yes."
    inner = [f"<h1>{title}</h1>"]
    for text in texts:
        style = rnd.randrange(5)
        first, _, rest = text.partition(" ")
        inner.append(
            [f"<p>{text}</p>", f"<p>{text}", f'<p><a href="/x">{first}</a> {rest}</p>', f"<p>{first}\n  <em>{rest}</em><br></p>", f"<div>{text}</div>"][style]
        )
        if rnd.random() < 0.2:
            inner.append(rnd.choice([
                f'<div class="ad-slot">{sentence(rnd)}</div>', f"<aside>{paragraph(rnd)}</aside>", "<script>var a = '<p>no</p>';</script>",
                f'<form action="/s"><p>{sentence(rnd)}</p><input name=q></form>', f'<div id="newsletter-box"><p>{sentence(rnd)}</p></div>',
                "<!-- <p>hidden</p> -->", f'<div style="display: none">{sentence(rnd)}</div>', "<style>p > a {{color: red}}</style>",
            ]))
    around = f"""<!DOCTYPE html><html lang=en><head><title>{title} - Site</title><meta charset="utf-8"></head><body class="home">
      <div class="cookie-notice"><p>{sentence(rnd)} {sentence(rnd)}</p><button>OK</button></div>
      <header><h2>Daily site</h2></header><nav><ul>{links(rnd, 7)}</ul></nav>
      {FRAMES[frame].replace("{nav}", links(rnd, 5)).replace("{}", "".join(inner))}
      <div class="sidebar"><h3>Popular</h3><ul>{links(rnd, 6)}</ul><p>{sentence(rnd)}</p></div>
      <section id="comments"><h3>Comments</h3>{"".join(f"<article class='comment'><p>{paragraph(rnd)}</p></article>" for _ in range(5))}</section>
      <div role="complementary"><p>{paragraph(rnd)}</p></div>
      <footer><p>&copy; 2024 {sentence(rnd)}</p></footer></body></html>"""
    return around, "\n".join([title, *texts])


@pytest.mark.parametrize("frame", FRAMES)
def test_layouts(frame):
    rnd = random.Random(frame)
    for _ in range(40):
        markup, text = page(rnd, frame)
        assert pt.main_text(markup) == text


def test_blocks_references_and_space():
    assert pt.main_text("<p>a &amp; b &lt;c&gt; &copy &#233;&#x1F600;&nbsp;\t x &am</p>") == "a & b <c> © é😀 x &am"
    assert pt.main_text("<article><ul><li>one<li>two</ul><dl><dt>t<dd>d</dl><table><tr><td>1<td>2<tr><th>3</table><pre>a\n  b</pre>") == "one\ntwo\nt\nd\n1\n2\n3\na b"
    assert pt.main_text("<article>lead<p>one<div>two<br>three</div>tail</article>") == "lead\none\ntwo three\ntail"
    assert pt.main_text("<article><b><p>one</b> two</p><p>th<i>ree</p></i> four</article>") == "one two\nthree\nfour"
    assert pt.main_text("<article><p title='a>b' data-x=\"</p>\" hidden=>x</p><p class=>1 < 2 and 3 <4</p></article>") == "1 < 2 and 3 <4"


@pytest.mark.parametrize(
    "markup,text",
    [
        (None, ""), ("", ""), (" \n", ""), ("plain words", "plain words"), ("<nav><a href=x>Home</a></nav>", ""), ("<p>cut <b>off", "cut off"),
        ("<p>kept</p><!-- open", "kept"), ("<p>kept</p><script>var x = 1", "kept"), ("<p>kept</p><a href=\"open", "kept"), ("a<", "a<"),
        ("<", "<"), ("</", "</"), ("</>x", "x"), ("<?xml version='1'?><p>x</p>", "x"), ("<title>T</title><p>x</p>", "x"), ("<head><p>x", "x"),
        ("<head><title>T</title></head>x", "x"), ("<p><![CDATA[x]]>y", "y"), ("<!-->x", "x"), ("</p></div>x</body>y", "xy"), ("<p =a b='c'd>x</p>", "x"),
        ("<footer>only</footer>", ""), ("<SCRIPT>x</Script ><P>y</P>", "y"), ("<div hidden>x</div>y", "y"), ("\x00<p>퟿\x85z</p>", "\x00\n퟿ z"),
    ],
)
def test_odd_markup(markup, text):
    assert pt.main_text(markup) == text


def test_comments_by_title_and_short_sections():
    texts = [f"<p>{paragraph(random.Random(k))}</p>" for k in range(8)]
    body = "<div>" + "".join(texts[:4]) + "</div><div><h2>More</h2><p>Short one.</p></div><div>" + "".join(texts[4:]) + "</div>"
    comments = "<div><h3>12 Comments</h3><p>" + "I disagree with this. " * 30 + "</p></div>"
    menu = '<div><a href="/">Home</a> <a href="/a">About us</a></div>'
    got = pt.main_text(f"{menu}<h1>Title</h1>{body}{comments}{menu}")
    assert got.startswith("Title\n") and "More\nShort one." in got and "disagree" not in got and "About" not in got


@pytest.mark.parametrize(
    "unit", ["<div>x", "<p>x", "<b><i>x</b>", '<a "', "<table><td>x", "<li>x<ul>", "&amp;", "<!--x", "<span>x</div>", "<a href='", "<script>x", "</p>", "<h1>x"]
)
def test_time_grows_with_length(unit):
    took = []
    for n in (20_000, 80_000):
        best = 9e9
        for _ in range(2):
            start = time.perf_counter()
            pt.main_text(unit * n)
            best = min(best, time.perf_counter() - start)
        took.append(best)
    assert took[1] < 12 * took[0] + 0.2


def test_deep_nesting_keeps_text():
    assert pt.main_text("<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000 + "<p>after</p>") == "deep\nafter"


def test_table_of_pages(spark):
    rows = [(1, "u", "<article><h1>A</h1><p>b</p></article>", 7), (1, "u", "<article><h1>A</h1><p>b</p></article>", 7), (2, None, None, None), (None, "v", "", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted((tuple(r) for r in pt.page_texts(df).collect()), key=repr)
    assert got == sorted([(1, "u", "A\nb")] * 2 + [(2, None, ""), (None, "v", "")], key=repr)
    assert pt.page_texts(df.where("false")).count() == 0

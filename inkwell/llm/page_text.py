"""Main text of web pages by composite text density (operator 13).

A page becomes a tree the way browsers read it: implied end tags, misnested and
unclosed elements, raw script text.  What elements, roles or class and id words name
as menu, header, footer, sidebar, notice, advert, form, script, style or reader
comments is left out.  Every node of the rest has a composite density, its characters
per tag lowered by the share of links in characters and tags, and a density sum over
its children, texts included.  The container with the greatest sum is the core of the
text.  Inside an ``article`` or ``main`` element the whole element is the text.
Elsewhere the threshold is the least density on the path from the core to the body:
what hangs beside that path and reaches the threshold belongs to the text with its own
densest subtree, as do headings right before it and whatever lies between two parts of
it without being mostly links.

Blocks are joined by one ``\\n``; white space in a block, as ``str.split`` sees it and
``<br>``, is one space; a table cell or list item is a block.

Defined results: null and empty pages, and pages of boilerplate only, have empty text;
an unterminated comment, tag or script ends the page; elements nested deeper than
``DEPTH`` are read as siblings, with all their text; ties go to the first node; repeated
rows are repeated; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from inkwell.llm.common import table
from inkwell.llm.tokens import sliced

#: Open elements at most, as in browsers.
DEPTH = 512
#: A part between two parts of the text is left out if more than this share of it is links.
MOSTLY_LINKS = 0.5

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table tbody "
    "td template tfoot th thead title tr ul".split()
)
#: Start tags that end an open p, and for each element the open ones that its start tag ends, up to a limit.
ENDS_P = BLOCK - set("body caption legend optgroup option select tbody td template tfoot th thead title tr".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"})),
}
TABLE_PARTS = set("table caption tbody thead tfoot tr td th".split())
SCOPES = {"table", "td", "th", "caption", "button", "object", "template"}
IN_HEAD = set("base link meta noscript script style template title".split())

#: What is not article text: elements, roles, and words of class and id attributes.
DROPPED = set(
    "aside button canvas datalist dialog embed fieldset footer form frame frameset head iframe input menu nav noembed noframes "
    "noscript object script search select style svg template textarea title".split()
)
DROPPED_ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar tooltip".split()
)
DROPPED_WORDS = set(
    "ad ads advert advertisement advertisements advertising adverts adsense advertorial banner breadcrumb breadcrumbs comment commentlist "
    "comments consent cookie cookies copyright disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification notifications overlay pager pagination paywall popup promo promoted promotion promotions recommendations "
    "recommended related replies respond responses share sharebar sharing sidebar sidebars signup skip social sponsor sponsored sponsors "
    "subscribe subscription subscriptions toolbar topbar widget widgets".split()
)
#: Words before such a word that turn its meaning, and words before "header" that make it the page's.
TURNED = {"has", "have", "no", "with", "without", "hide", "non", "is"}
PAGE_HEADER = {"site", "page", "global", "top", "main", "web", "website", "app"}
COMMENTS_TITLE = re.compile(r"(\d+ )?(reader |user )?(comments?|responses?|replies|leave a (comment|reply))( ?\(\d+\))?:?", re.I)

_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)\s*(=?)\s*")
_VALUE = re.compile(r"[^\s>]*")
_TAG_END = re.compile(r"[\s/]*>")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(page: str, at: int) -> tuple[dict, int]:
    """Attributes of a tag and the place behind it; -1 if the page ends within it."""
    found: dict[str, str] = {}
    while True:
        end = _TAG_END.match(page, at)
        if end:
            return found, end.end()
        name = _ATTRIBUTE.match(page, at)
        if not name:
            stray = _WORD_GAP.match(page, at)
            if stray.end() >= len(page):
                return found, -1
            at = stray.end() + 1  # a lone equals sign
            continue
        at, value = name.end(), ""
        if name[2]:
            quote = page[at : at + 1]
            if quote and quote in "\"'":
                close = page.find(quote, at + 1)
                if close < 0:
                    return found, -1
                value, at = page[at + 1 : close], close + 1
            else:
                plain = _VALUE.match(page, at)
                value, at = plain[0], plain.end()
        found.setdefault(name[1].lower(), value)


_WORD_GAP = re.compile(r"[\s/]*")


class Tree:
    """Elements of a page in order of their start tags; element 0 is the body.

    ``events`` has k for the start of element k, ~k for its end, and texts.
    """

    def __init__(self, page: str):
        self.tags, self.parents, self.attributes, self.events = ["body"], [-1], [{}], []
        self._open, self._count = [0], {}
        self._read(page)
        while len(self._open) > 1:
            self._pop()

    def _push(self, tag: str, attributes: dict) -> None:
        k = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.attributes.append(attributes)
        self.events.append(k)
        if tag in VOID or len(self._open) >= DEPTH:
            self.events.append(~k)
        else:
            self._open.append(k)
            self._count[tag] = self._count.get(tag, 0) + 1

    def _pop(self) -> None:
        k = self._open.pop()
        self._count[self.tags[k]] -= 1
        self.events.append(~k)

    def _close(self, names: set[str], limits: set[str]) -> None:
        """End the nearest open element of some names, and all within it, unless a limit comes first."""
        if not any(self._count.get(name) for name in names):
            return
        for place in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[place]]
            if tag in names:
                while len(self._open) > place:
                    self._pop()
                return
            if tag in limits:
                return

    def _start(self, tag: str, attributes: dict) -> None:
        if tag in ("html", "body"):
            self._close({"head"}, set())
            return
        if self._count.get("head") and tag not in IN_HEAD:
            self._close({"head"}, set())
        if tag in ENDS_P:
            self._close({"p"}, SCOPES)
        if tag in IMPLIED:
            names, limits = IMPLIED[tag]
            if tag in TABLE_PARTS:  # a row ends the open row and its cells, innermost first
                while any(self._count.get(n) for n in names):
                    before = len(self._open)
                    self._close(names, limits)
                    if len(self._open) == before:
                        break
            else:
                self._close(names, limits)
        if tag[0] == "h" and tag[1:].isdigit() and self.tags[self._open[-1]][0] == "h" and self.tags[self._open[-1]][1:].isdigit():
            self._pop()
        self._push(tag, attributes)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in TABLE_PARTS:
            self._close({tag}, {"table"} - {tag})
        elif tag in BLOCK or tag in SCOPES or tag == "head":
            self._close({tag}, SCOPES - {tag})
        else:
            self._close({tag}, BLOCK | SCOPES)

    def _text(self, text: str) -> None:
        if text:
            if self._count.get("head") and self.tags[self._open[-1]] == "head" and not text.isspace():
                self._close({"head"}, set())
            self.events.append(html.unescape(text) if "&" in text else text)

    def _read(self, page: str) -> None:
        at, size, lower = 0, len(page), None
        held = 0  # where the text that is not handed on yet starts
        while True:
            start = page.find("<", at)
            if start < 0:
                self._text(page[held:])
                return
            mark = page[start + 1 : start + 2]
            if mark in ("!", "?") or (mark == "/" and start + 2 < size and not page[start + 2].isalpha()):
                self._text(page[held:start])
                if page.startswith("<!--", start):
                    if page.startswith((">", "->"), start + 4):
                        end, width = page.find(">", start + 4), 1
                    else:
                        end, width = page.find("-->", start + 4), 3
                else:
                    end, width = page.find(">", start + 2), 1
                if end < 0:
                    return
                held = at = end + width
            elif (mark == "/" and start + 2 < size) or (mark.isascii() and mark.isalpha()):
                self._text(page[held:start])
                name = _NAME.match(page, start + 1 + (mark == "/"))
                tag = name[0].lower()
                attributes, at = _attributes(page, name.end())
                if at < 0:
                    return
                held = at
                if mark == "/":
                    self._end(tag)
                    continue
                self._start(tag, attributes)
                if tag in RAW:
                    lower = lower if lower is not None else page.lower()
                    end = lower.find("</" + tag, at) if len(lower) == size else page.find("</" + tag, at)
                    if end < 0:
                        return
                    if self.tags[self._open[-1]] == tag:
                        self._pop()
                    _, at = _attributes(page, end + 2 + len(tag))
                    if at < 0:
                        return
                    held = at
            else:
                at = start + 1


def is_boilerplate(tag: str, attributes: dict, in_article: bool) -> int:
    """2: by element or role, or hidden; 1: by class or id words; 0: not."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return 2
    if not attributes:
        return 0
    role = attributes.get("role", "").strip().lower()
    if role in DROPPED_ROLES and not (role == "banner" and in_article):
        return 2
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attributes.get("style", "")):
        return 2
    if tag in ("main", "body") or tag in ("h1", "h2", "h3", "h4", "h5", "h6", "em", "strong", "b", "i"):
        return 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        for k, word in enumerate(words):
            if word in DROPPED_WORDS and not (k and words[k - 1] in TURNED):
                return 1
            if word == "header" and (len(words) == 1 and not in_article or k and words[k - 1] in PAGE_HEADER):
                return 1
    return 0


class Density:
    """Composite densities and density sums of the elements and texts that are not boilerplate."""

    def __init__(self, tree: Tree):
        n = len(tree.tags)
        self.tree, tags, parents = tree, tree.tags, tree.parents
        inside, holds = [False] * n, [False] * n
        kinds = [0] * n
        for k in range(1, n):
            inside[k] = inside[parents[k]] or tags[k] in ("article", "main")
            kinds[k] = is_boilerplate(tags[k], tree.attributes[k], inside[parents[k]])
        for k in range(n - 1, 0, -1):
            # words on a wrapper around the article do not make it boilerplate
            own = tags[k] == "main" or (tags[k] == "article" and not kinds[k])
            if kinds[k] == 1 and holds[k]:
                kinds[k] = 0
            if (own or holds[k]) and not kinds[k]:
                holds[parents[k]] = True
        self.dropped = dropped = [False] * n
        for k in range(1, n):
            dropped[k] = dropped[parents[k]] or kinds[k] > 0
        self._drop_comments()

        self.texts = []  # (event, element, characters)
        in_link = [False] * n
        chars, links, count, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for k in range(1, n):
            in_link[k] = in_link[parents[k]] or tags[k] == "a"
        at = 0
        for place, event in enumerate(tree.events):
            if isinstance(event, str):
                size = 0 if dropped[at] else len(" ".join(event.split()))
                if size:
                    self.texts.append((place, at, size))
                    chars[at] += size
                    links[at] += size * in_link[at]
            elif event >= 0:
                at = event
            else:
                at = parents[~event]
        for k in range(n - 1, 0, -1):
            if not dropped[k]:
                p = parents[k]
                chars[p] += chars[k]
                links[p] += links[k]
                count[p] += count[k] + 1
                link_tags[p] += link_tags[k] + (tags[k] == "a")
        self.chars, self.links = chars, links
        share = links[0] / max(chars[0], 1)

        def density(c: int, lc: int, t: int, lt: int) -> float:
            """Characters per tag times a logarithm that falls with the share of links."""
            if not c:
                return 0.0
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            ratio = c / max(lc, 1) * max(t, 1) / max(lt, 1)
            return c / max(t, 1) * math.log(ratio) / max(math.log(base), 1e-9) if ratio > 1 else 0.0

        self.own = [density(chars[k], links[k], count[k], link_tags[k]) for k in range(n)]
        self.of_text = {place: density(size, size * in_link[k], 1, 0) for place, k, size in self.texts}
        self.sums, self.has_blocks = [0.0] * n, [False] * n
        for k in range(1, n):
            if not dropped[k]:
                self.sums[parents[k]] += self.own[k]
                self.has_blocks[parents[k]] |= tags[k] in BLOCK and chars[k] > 0
        for place, k, _ in self.texts:
            self.sums[k] += self.of_text[place]

    def _drop_comments(self) -> None:
        """Leave out sections whose title says that readers' comments follow."""
        tree, at = self.tree, 0
        for event in tree.events:
            if isinstance(event, str):
                k = tree.parents[at]
                if at and tree.tags[at] in ("h1", "h2", "h3", "h4", "h5", "h6", "p") and k and tree.tags[k] in ("section", "div", "ul", "ol"):
                    if COMMENTS_TITLE.fullmatch(" ".join(event.split())):
                        self.dropped[k] = True
            elif event >= 0:
                at = event
            else:
                at = tree.parents[~event]
        for k in range(1, len(tree.tags)):
            self.dropped[k] = self.dropped[k] or self.dropped[tree.parents[k]]

    def core(self) -> int:
        """The container with the greatest density sum; the body if no element holds blocks."""
        best = 0
        for k in range(len(self.sums)):
            if self.has_blocks[k] and not self.dropped[k] and (not self.has_blocks[best] or self.sums[k] > self.sums[best]):
                best = k
        return best

    def kept(self) -> set[int]:
        """Events of the texts that belong to the main text."""
        tree = self.tree
        core = self.core()
        path = [core]
        while path[-1]:
            path.append(tree.parents[path[-1]])
        whole = [k for k in path if tree.tags[k] == "article"][-1:] or [k for k in path if tree.tags[k] == "main"][:1]
        if whole:
            return self._within({whole[0]})
        threshold = min(self.own[k] for k in path)
        chosen, on_path = {core}, set(path)
        best = list(range(len(tree.tags)))  # of each element, where in its subtree the greatest sum is
        for k in range(len(tree.tags) - 1, 0, -1):
            p = tree.parents[k]
            if not self.dropped[k] and self.sums[best[k]] > self.sums[best[p]]:
                best[p] = best[k]
        for k in range(1, len(tree.tags)):
            if not self.dropped[k] and k not in on_path and self.chars[k] and self.own[k] >= threshold:
                chosen.add(best[k])
        found = self._within(chosen)
        found |= {place for place, k, _ in self.texts if k in on_path and self.of_text[place] >= threshold}
        return found | self._between(found, on_path)

    def _within(self, roots: set[int]) -> set[int]:
        inside = [k in roots for k in range(len(self.tree.tags))]
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.tree.parents[k]]
        return {place for place, k, _ in self.texts if inside[k]}

    def _between(self, found: set[int], on_path: set[int]) -> set[int]:
        """Texts between the first and the last one found, and headings before them, unless mostly links."""
        if not found:
            return set()
        tree, first, last = self.tree, min(found), max(found)
        more, titles = set(), set()
        for place, k, _ in self.texts:
            top = k
            while top and top not in on_path and tree.parents[top] not in on_path:
                top = tree.parents[top]
            if top in on_path:
                fits = True
            else:
                fits = self.links[top] <= MOSTLY_LINKS * self.chars[top]
            if place in found or not fits:
                continue
            if first < place < last:
                more.add(place)
            elif place < first:
                heading = next((tree.tags[e] for e in self._up(k) if tree.tags[e][0] == "h" and tree.tags[e][1:].isdigit()), None)
                if heading == "h1":
                    more.add(place)
                elif heading:
                    titles.add(place)
                else:
                    titles.clear()
        return more | titles

    def _up(self, k: int):
        while k:
            yield k
            k = self.tree.parents[k]


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    if not page:
        return ""
    density = Density(Tree(page))
    kept, tree = density.kept(), density.tree
    blocks, run = [], []
    for place, event in enumerate(tree.events):
        if isinstance(event, str):
            if place in kept:
                run.append(event)
        else:
            tag = tree.tags[event if event >= 0 else ~event]
            if tag == "br":
                run.append(" ")
            elif tag in BLOCK and run:
                blocks.append(run)
                run = []
    blocks.append(run)
    lines = (" ".join("".join(run).split()) for run in blocks)
    return "\n".join(line for line in lines if line)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page; ``pages`` have page_id, url and html."""

    def read(batches):
        for batch in sliced(batches, 256):
            texts = pa.array([main_text(page.as_py()) for page in batch["html"]], pa.string())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], texts], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(read, "page_id long, url string, text string")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of the pages table."""
    found = page_texts(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


#: For pages whose only article element holds headings, paragraphs, bold runs and line breaks, as in the given tables.
OP13_SQL = r"""
WITH cut AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
pieces AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(regexp_replace(body, '</?b>', '', 'g'), '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(replace(x, '<br>', ' '), '\s+', ' ', 'g'))) AS parts FROM cut),
plain AS (
  SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS marked FROM pieces),
decoded AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(marked, '&#x27;', chr(39)),
    '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS text FROM plain)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM decoded
"""

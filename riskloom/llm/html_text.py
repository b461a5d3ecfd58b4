"""Main text of HTML pages by composite text density.

Each page becomes a tree of elements. What is never article text goes with its subtree: navigation, page headers,
footers, asides, forms, scripts, styles, and elements whose class, id or role has a whole name of an advert, menu, sidebar, notice or
comment (``BESIDE``), unless they are of two blocks of text or more and hold most of the page's text or its densest element;
comments and consent texts, which can outweigh an article, are left out even then, if any other text is left. Every other element gets a density: characters per tag, adjusted by its share of link characters
and link tags. Formatting within a line is text of its element and no tag. The element with the largest sum of its children's densities is the content; elements whose density
reaches the least on the path from it to the body may hold more of it. Within the content, blocks of mostly links below that least are left out.
No tag name makes an element content. So of several texts side by side those less dense than all of that path, such as very short ones, are left out.
Text is read block by block in page order.

Pages are worked on one by one in Arrow batches; nothing is shuffled.

Defined cases: a null or empty page, or one without text, gives the empty text. Broken and cut-off markup is read as far as it goes.
Repeated rows, null ids and null urls are passed through. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NEVER = set("head title script style noscript template nav footer aside form button select textarea iframe object svg canvas dialog menu map audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = ("article", "main")
# Elements that end a run of text where they start and end.
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
            "hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
# An element that starts closes an open one of these, up to the given border.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Whole names in class, id or role; "_" counts as "-", and a number at the end does not count.
BESIDE = set(
    "ad ads adsbygoogle advert adverts advertise advertisement advertisements advertising banner banners sponsor sponsors sponsored promo promos promoted promotion "
    "promotions cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription sidebar side-bar widget widgets menu nav navbar "
    "navigation breadcrumb breadcrumbs footer site-header page-header masthead comment comments commentlist disqus replies share sharing social related "
    "recommended recommendations copyright disclaimer toolbar pagination pager skip-link contentinfo complementary search "
    # compounds
    "ad-banner ad-block ad-box ad-container ad-label ad-slot ad-space ad-unit ad-wrapper ads-container ads-wrapper banner-ad banner-ads google-ad google-ads side-ad text-ad top-ad "
    "ad-top ad-bottom bottom-ad advert-box advertisement-label sponsored-content sponsored-links sponsored-post promo-banner promo-bar promo-block promo-box top-banner bottom-banner "
    "cookie-banner cookie-bar cookie-box cookie-consent cookie-message cookie-notice cookie-notification cookie-policy cookie-popup cookie-warning cookies-banner cookies-notice "
    "consent-banner consent-bar gdpr-banner gdpr-notice copyright-notice legal-notice privacy-notice site-notice notice-bar popup-overlay modal-dialog modal-window "
    "newsletter-box newsletter-form newsletter-popup newsletter-signup subscribe-box subscribe-form subscription-form left-sidebar right-sidebar main-sidebar page-sidebar "
    "primary-sidebar secondary-sidebar sidebar-left sidebar-right sidebar-primary sidebar-secondary sidebar-widget sidebar-widgets side-menu side-nav widget-area "
    "footer-menu footer-nav main-menu main-nav main-navigation mobile-menu mobile-nav nav-bar nav-links nav-list nav-menu page-nav post-nav post-navigation primary-menu primary-nav "
    "secondary-nav site-menu site-nav site-navigation sub-menu sub-nav top-menu top-nav user-menu breadcrumb-list breadcrumb-nav footer-links footer-widgets page-footer site-footer "
    "comment-area comment-box comment-form comment-list comment-respond comment-section comments-area comments-list comments-section comments-wrapper disqus-thread user-comments "
    "share-bar share-box share-button share-buttons share-links sharing-buttons social-bar social-buttons social-icons social-links social-media social-share "
    "related-articles related-content related-links related-news related-posts related-products related-stories related-topics recommended-articles recommended-content "
    "recommended-posts recommended-stories page-pagination skip-links skip-nav skip-to-content search-bar search-box search-form".split())
OUTWEIGH = ("comment", "disqus", "replies", "cookie", "consent", "gdpr")  # names of what can be longer than the article
NUMBER = re.compile(r"-?\d+$")
# Formatting within a line; with a block inside it is an element like any other.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
             "time tt u var wbr".split())
LINKS = 3  # links of a block that is left out for them
LEAST_BASE = math.e ** math.e  # the logarithm's base is e where nothing is linked
SPACE = re.compile(r"\s+")


def named_beside(names: str) -> int:
    """0: no name of what stands beside an article; 2: one of what can outweigh it; 1: another."""
    found = [x for x in names.lower().replace("_", "-").split() if x in BESIDE or NUMBER.sub("", x) in BESIDE]
    return (1 + any(x.startswith(OUTWEIGH) for x in found)) if found else 0


class Tree(HTMLParser):
    """Elements in page order with their own text; blocks of text and the element each belongs to.

    Whether a named element is left out is known when the page is: ``settle`` says so, until then blocks are runs of (element, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.dropped, self.linked = ["#page"], [-1], [False], [False]
        self.beside = [0]
        self.own: list[int] = [0]
        self.stack = [0]
        self.blocks: list[tuple[int, str]] = []
        self.run: list[tuple[int, str]] = []
        self.runs: list[tuple[int, list[tuple[int, str]]]] = []

    def _end_block(self) -> None:
        if self.run:
            node = next((n for n in reversed(self.stack) if self.tag[n] in BLOCK), 0)
            if not self.dropped[self.stack[-1]]:
                self.runs.append((node, self.run))
            self.run = []

    def settle(self, left_out: set[int]) -> None:
        """Drop these elements with their subtrees, and join the blocks' text; what is dropped is a space."""
        if left_out:
            for i in range(1, len(self.tag)):
                self.dropped[i] |= i in left_out or self.dropped[self.parent[i]]
                if self.dropped[i]:
                    self.own[i] = 0
        for node, run in self.runs:
            if text := SPACE.sub(" ", "".join(" " if self.dropped[i] else x for i, x in run)).strip():
                self.blocks.append((node, text))

    def _close_to(self, depth: int) -> None:
        if any(self.tag[n] in BLOCK for n in self.stack[depth:]):
            self._end_block()
        del self.stack[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._end_block()
            for depth in range(len(self.stack) - 1, 0, -1):  # a block ends an open paragraph
                if self.tag[self.stack[depth]] == "p":
                    self._close_to(depth)
                    break
                if self.tag[self.stack[depth]] in BLOCK:
                    break
        if tag in CLOSES:
            ends, border = CLOSES[tag]
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.tag[self.stack[depth]] in border:
                    break
                if self.tag[self.stack[depth]] in ends:
                    self._close_to(depth)
                    break
        up = self.stack[-1]
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        inside = any(self.tag[n] in ARTICLE for n in self.stack)
        never = tag in NEVER or (tag == "header" and not inside)
        beside = named_beside(named) if named and tag not in ("html", "body", "main") else 0
        hidden = any(k == "hidden" for k, _ in attrs)
        self.tag.append(tag)
        self.parent.append(up)
        self.dropped.append(self.dropped[up] or never or hidden)
        self.beside.append(beside)
        self.linked.append(self.linked[up] or tag == "a")
        self.own.append(0)
        if tag == "br":
            self.run.append((up, " "))
        if tag not in VOID:
            if (self.dropped[-1] or beside) and not self.dropped[up] and self.run:  # text before stays, what is dropped leaves no trace
                self.run.append((len(self.tag) - 1, ""))
            self.stack.append(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "a", "li", "script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[depth]] == tag:
                self._close_to(depth)
                break

    def handle_data(self, data: str) -> None:
        node = self.stack[-1]
        if self.dropped[node]:
            return
        self.own[node] += len(SPACE.sub(" ", data).strip())
        self.run.append((node, data))

    def finish(self) -> None:
        self.close()
        self._close_to(1)
        self._end_block()


def densities(t: Tree) -> tuple[list[float], list[float], list[bool]]:
    """(density, sum of the children's densities, whether it is mostly links) of every element; dropped ones and formatting have none."""
    n = len(t.tag)
    chars, tags, link_chars, link_tags = list(t.own), [0] * n, [c if k else 0 for c, k in zip(t.own, t.linked)], [0] * n
    apart = [x not in INLINE for x in t.tag]
    for i in range(n - 1, 0, -1):
        if not t.dropped[i]:
            up = t.parent[i]
            apart[up] |= apart[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + (apart[i] or t.tag[i] == "a")
            link_tags[up] += link_tags[i] + (t.tag[i] == "a")
    body = t.tag.index("body") if "body" in t.tag else 0
    linked_share = link_chars[body] / max(1, chars[body])
    density, total, links = [0.0] * n, [0.0] * n, [False] * n
    for i in range(n - 1, -1, -1):
        if t.dropped[i] or not chars[i]:
            continue
        if not apart[i]:  # text counts as a child with one tag
            total[t.parent[i]] += float(chars[i]) if apart[t.parent[i]] else 0.0
            continue
        plain = max(1, chars[i] - link_chars[i])
        base = math.log(chars[i] * link_chars[i] / plain + linked_share * chars[i] + LEAST_BASE)
        value = chars[i] / max(1, link_chars[i]) * max(1, tags[i]) / max(1, link_tags[i])
        density[i] = chars[i] / max(1, tags[i]) * math.log(value + 1.0) / math.log(base)
        total[i] += float(t.own[i])
        links[i] = link_tags[i] >= LINKS and 2 * link_chars[i] > chars[i]
        if i:
            total[t.parent[i]] += density[i]
    return density, total, links


def _above(t: Tree, node: int) -> list[int]:
    """The element and what it lies in, up to the body."""
    path = [node]
    while node > 0 and t.tag[node] != "body":
        node = t.parent[node]
        path.append(node)
    return path


def beside(t: Tree) -> set[int]:
    """The named elements that are left out."""
    n = len(t.tag)
    named = [i for i in range(n) if t.beside[i] and not t.dropped[i]]
    if not named:
        return set()
    chars, blocks = list(t.own), [0] * n
    for i in {i for i, run in t.runs if any(x.strip() for _, x in run)}:
        blocks[i] = 1
    for i in range(n - 1, 0, -1):
        chars[t.parent[i]] += chars[i]
        blocks[t.parent[i]] += blocks[i]
    if all(blocks[i] < 2 for i in named):
        return set(named)
    _, total, _ = densities(t)
    holds = set(_above(t, max(range(n), key=lambda i: total[i])))
    kept = {i for i in named if blocks[i] > 1 and (i in holds or 2 * chars[i] > chars[0])}
    out = {i for i in named if i not in kept or t.beside[i] == 2}
    gone = [False] * n
    for i in range(1, n):
        gone[i] = i in out or gone[t.parent[i]]
    return out if any(c and not g for c, g in zip(t.own, gone)) else out - kept


def content(t: Tree) -> tuple[set[int], set[int]]:
    """(elements whose subtrees are the article, elements within them that are left out)."""
    density, total, links = densities(t)
    n = len(t.tag)
    best_below = list(range(n))  # the element with the largest sum within each subtree, itself included
    for i in range(n - 1, 0, -1):
        up = t.parent[i]
        if not t.dropped[i] and total[best_below[i]] > total[best_below[up]]:
            best_below[up] = best_below[i]
    body = t.tag.index("body") if "body" in t.tag else 0
    best = best_below[body]
    path = _above(t, best)
    threshold = min(density[i] for i in path)
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        children.setdefault(t.parent[i], []).append(i)
    marked, waiting = set(), [body]
    while waiting:
        i = waiting.pop()
        if not t.dropped[i] and density[i] >= threshold and density[i] > 0:
            marked.add(best_below[i])
            waiting.extend(children.get(i, []))
    return marked, {i for i in range(n) if links[i] and density[i] < threshold}


def main_text(html: str | None) -> str:
    """The article's blocks, one per line."""
    if not html:
        return ""
    t = Tree()
    t.feed(html)
    t.finish()
    t.settle(beside(t))
    if not t.blocks:
        return ""
    marked, left_out = content(t)
    inside = [False] * len(t.tag)
    for i in range(len(t.tag)):
        inside[i] = i not in left_out and (i in marked or (i > 0 and inside[t.parent[i]]))
    return "\n".join(text for node, text in t.blocks if inside[node])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    schema = T.StructType([pages.schema[page_id], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                texts = [main_text(h) for h in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return pages.select(page_id, url, html).mapInArrow(run, schema)

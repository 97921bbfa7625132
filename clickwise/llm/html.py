"""Main text of web pages by consensus of container paths per host.

Every page scores its containers; each host votes, in Spark, for the
generalised tag-class path that gathers the most text over its pages; then
each page is extracted again from the containers on its host's path. Pages
that lack the path use their own best container.

Elements that only their names (or a form tag) mark as furniture are judged
by their text: one that holds an article or a main element is none, nor is
one with most of the page's unlinked text, if no article or main is elsewhere.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML, and words that name page furniture.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "head script style noscript template nav footer aside form button select textarea iframe object svg canvas menu dialog "
    "audio video".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer header masthead comment comments reply replies disqus cookie cookies consent notice notices banner "
    "popup modal newsletter subscribe signup share sharing social related recommended recommendations pagination pager widget "
    "form login search".split())
# Of these names, those that are never an article's own, however long the element is.
ALIEN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo breadcrumb breadcrumbs disqus cookie cookies consent "
    "popup modal newsletter subscribe share sharing pagination pager login".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CLOSES_P = BLOCK - frozenset("body html option tbody thead tfoot tr td th summary legend".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table menu select".split())

# Names that tell how a page or an article is laid out, not what the element is.
_LAYOUT = re.compile(r"\b(?:with|without|has|have|no|hide|show|left|right|both|one|two)[-_]+[a-z]+(?:[-_]+[a-z]+)*"
                     r"|\b(?:article|post|entry|story|page|content|section)[-_]+(?:header|heading)\b")

_REPLIES = frozenset("comment comments reply replies disqus".split())
_SPACE = re.compile(r"\s+")
_NAMES = re.compile(r"[a-z]+")


class _Node:
    __slots__ = ("tag", "parent", "path", "hidden", "doubt", "alien", "worth", "holds", "prose", "titled")

    def __init__(self, tag, parent, path, hidden, doubt=False, alien=False):
        self.tag, self.parent, self.path, self.hidden, self.doubt, self.alien = tag, parent, path, hidden, doubt, alien
        self.worth, self.holds, self.prose, self.titled = 0, False, False, False


class _Page(HTMLParser):
    """Blocks ``(node, text, link characters)`` of a page in order, hidden ones left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = _Node("", None, "", False)
        self.blocks, self.text, self.links, self.in_link = [], [], 0, 0

    def flush(self):
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            node = self.at
            while node.parent and node.tag not in BLOCK:
                node = node.parent
            self.blocks.append((node, text, self.links))
        self.text, self.links = [], 0

    def _leave(self, tags, scopes):
        node = self.at
        while node.parent and node.tag not in tags:
            if node.tag in scopes:
                return
            node = node.parent
        if node.parent:
            self.flush()
            self.at = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P:
                self._leave(("p",), BLOCK - {"p"})
            if tag in SIBLINGS:
                self._leave(SIBLINGS[tag], SCOPES)
                if tag == "tr":
                    self._leave(("tr",), SCOPES)
        if tag == "br":
            self.text.append(" ")
        if tag == "body":
            self._leave(("head",), ())
        if tag in VOID:
            return
        found = {k: v or "" for k, v in attrs}
        classes = sorted({c for w in found.get("class", "").lower().split() if (c := re.sub(r"[^a-z_-]+", "", w))})
        path = f"{self.at.path}>{'.'.join([tag, *classes])}"
        root = tag in ("html", "body", "main", "article")
        named = {n for k in ("class", "id") for n in _NAMES.findall(_LAYOUT.sub(" ", found.get(k, "").lower()))}
        inside = ">article" in self.at.path or ">main" in self.at.path
        hidden = (self.at.hidden or tag in HIDDEN and tag != "form" or "hidden" in found or found.get("aria-hidden") == "true"
                  or found.get("role", "") in ROLES or (tag == "header" and not inside)
                  or bool(re.search(r"display\s*:\s*none", found.get("style", ""))))
        doubt = tag == "form" or bool(named & (FURNITURE if not root else {"comment", "comments", "reply"})) and tag not in ("html", "body")
        alien = bool(named & ALIEN) and not root
        if tag not in BLOCK:
            # An advert inside a paragraph is no block of its own; the paragraph goes on around it.
            hidden = hidden or alien
        self.at = _Node(tag, self.at, path, hidden, doubt and not hidden, alien and not hidden)
        if tag in ("article", "main") and not doubt and not hidden:
            up = self.at.parent
            while up:
                up.holds, up = True, up.parent
        self.in_link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag == "br":
            self.text.append(" ")
        elif tag in BLOCK:
            self.flush()
            self._leave((tag,), ())
        elif tag not in VOID:
            self._leave_inline(tag)

    def _leave_inline(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            if node.tag in BLOCK:
                return
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        if not self.at.hidden:
            self.text.append(data)
            if self.in_link:
                self.links += len(data)


def _blocks(html: str | None):
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    top, total = page.at, 0
    while top.parent:
        top = top.parent
    for node, text, links in page.blocks:
        plain = max(0, len(text) - links)
        total += plain
        prose, titled = node.tag in PROSE, node.tag == "h1"
        while node:
            node.worth, node.prose, node.titled, node = node.worth + plain, node.prose or prose, node.titled or titled, node.parent

    def furniture(node):
        while node:
            outside = top.holds and not re.search(">(?:article|main)", node.path)
            if node.doubt and not node.holds and (outside or 2 * node.worth <= total or node.alien and not node.titled
                                                  or node.tag == "form" and not node.prose):
                return True
            node = node.parent
        return False
    # Comments are furniture however long they are; a page of nothing but furniture has no text.
    return [b for b in page.blocks if not furniture(b[0]) and not _replies(b[0])]


def _replies(node):
    """Whether ``node`` lies in comments: an element named so that holds no article."""
    while node:
        if node.doubt and not node.holds and _REPLIES & {*_NAMES.findall(node.path.rpartition(">")[2])}:
            return True
        node = node.parent
    return False


def _container(node):
    """The nearest article or main element, else the node itself."""
    found, up = None, node
    while up:
        if up.tag in ("article", "main"):
            found = up
        up = up.parent
    return found or node


def _scores(blocks) -> dict[str, float]:
    """Text gathered by the containers of a page, by generalised path."""
    out: dict[str, float] = {}
    worths = [len(text) * (1 - min(1.0, links / len(text))) for _, text, links in blocks]
    # The headline belongs to the article, however short it is: it weighs a tenth of the page.
    title = next((k for k, (node, *_) in enumerate(blocks) if node.tag == "h1"), None)
    if title is not None:
        worths[title] += sum(worths) / 10
    for (node, *_), worth in zip(blocks, worths):
        holder = node if node.tag in ("div", "section", "article", "main", "td", "body", "") else node.parent
        own = _container(holder)
        # The element around counts nearly as much: it wins where the text is not all in one of its parts.
        for share in (1.0, 0.95):
            if own is None:
                break
            out[own.path] = out.get(own.path, 0.0) + worth * share
            if own.tag in ("article", "main"):
                break
            own = own.parent
    return out


def _best(scores: dict[str, float]) -> str | None:
    return max(scores, key=lambda p: (scores[p], -p.count(">"), p)) if scores else None


def extract(html: str | None, path: str | None) -> str:
    """Text of the containers on ``path`` (of the page's best one, if none is there)."""
    blocks = _blocks(html)

    def chosen(want):
        return [t for node, t, _ in blocks if node.path == want or node.path.startswith(f"{want}>")] if want is not None else []
    return "\n".join(chosen(path) or chosen(_best(_scores(blocks))))


def host_of(url):
    """Lower-cased host without user or port; pages without one vote as host ''."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """``(host, path)``: per host the path with the most text over all its pages; ties go to the smaller path."""
    def run(batches):
        for b in batches:
            rows = [(h, p, round(s)) for h, t in zip(b["host"], b["html"]) for p, s in _scores(_blocks(t)).items()]
            yield pd.DataFrame(rows, columns=["host", "path", "score"]).groupby(["host", "path"], as_index=False).sum()
    votes = (pages.select(host_of(F.col("url")).alias("host"), "html").mapInPandas(run, "host string, path string, score long")
             .groupBy("host", "path").agg(F.sum("score").alias("score")))
    # max of (score, path): the length of the path breaks ties before its name.
    best = F.max(F.struct("score", (-F.length("path")).alias("short"), "path"))
    return votes.groupBy("host").agg(best.alias("best")).select("host", "best.path")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages(page_id, url, html)``; null html is empty."""
    def run(html, path):
        return pd.Series([extract(h, p) for h, p in zip(html, path)], dtype=object)
    run.__annotations__ = {"html": pd.Series, "path": pd.Series, "return": pd.Series}
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    return (named.join(host_paths(pages), "host", "left")
            .select("page_id", "url", F.pandas_udf(run, "string")("html", "path").alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))

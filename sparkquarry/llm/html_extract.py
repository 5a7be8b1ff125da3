"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with its path of tags from the root. What the markup
itself names as no article (menus, footers, forms, adverts, comments and their like, by tag, role
or class) is set aside. Text length and punctuation of the rest are added up for each path and
divided by the path's blocks; both ratios are smoothed over the page's blocks in order, fused by
their product (less for link text), and the paths whose mean reaches a share of the scores'
standard deviation hold the content. The smallest part of the page around these blocks and the
top headings is the article: an article or main element where there is one, of which everything
stays, or else the blocks from the first to the last of them, without lists of links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkquarry.llm.shared import table

_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
#: An open element of the second kind ends where one of the first starts.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
_BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_ASIDE = set("head script style noscript template nav footer aside form menu dialog iframe object svg canvas audio video select button textarea title xmp noembed noframes datalist".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
_ASIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr"
    " notice notices popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments commentlist disqus respond reply replies pagination pager"
    " widget widgets toolbar".split()
)
_HEAD_WORDS = {"header", "masthead", "banner", "topbar"}
_ARTICLE_WORDS = {"article", "post", "entry", "content", "main", "story"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

KERNEL = np.array([0.06, 0.24, 0.4, 0.24, 0.06])  # a Gaussian over five blocks
SHARE = 0.5  # of the standard deviation that a path's score must reach


class Element:
    """An open element: its label in paths, whether it is set aside, and the article or main element around it."""

    __slots__ = ("aside", "hinted", "label", "links", "name", "parent", "within")

    def __init__(self, name: str, attributes: str, parent: Element | None) -> None:
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        named = f"{found.get('class', '')} {found.get('id', '')}".strip()
        self.name, self.parent = name, parent
        self.label = f"{name}.{named.split()[0].lower()}" if named else name
        self.within = self if name in ("article", "main") or found.get("role") in ("main", "article") else parent and parent.within
        self.links = name == "a" or bool(parent and parent.links)
        head = name == "header" and not (parent and parent.within)
        self.aside = bool(parent and parent.aside) or name in _ASIDE or head or found.get("role", "").lower() in _ROLES or "hidden" in found
        self.hinted = self.aside or bool(parent and parent.hinted) or bool(named and self.within is not self and name not in ("html", "body") and self._named_aside(named))

    def _named_aside(self, named: str) -> bool:
        for word in re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", named).lower().split():
            parts = re.split(r"[^a-z0-9]+", word)
            if {"has", "with", "no", "without"} & set(parts):  # tells what else there is
                continue
            if _ASIDE_WORDS & set(parts) or (_HEAD_WORDS & set(parts) and not self.within and not _ARTICLE_WORDS & set(parts)):
                return True
        return False

    def path(self) -> list[Element]:
        """The elements from the root to this one."""
        found, at = [], self
        while at is not None:
            found.append(at)
            at = at.parent
        return found[::-1]


class Block:
    """A stretch of text between the borders of blocks."""

    __slots__ = ("chars", "links", "of", "punctuation", "text")

    def __init__(self, of: Element, pieces: list[tuple[str, bool]]) -> None:
        self.of, self.text = of, " ".join("".join(p for p, _ in pieces).split())
        self.chars, self.links = len(self.text), sum(len(p.strip()) for p, link in pieces if link)
        self.punctuation = len(_PUNCTUATION.findall(self.text))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, empty ones left out. Tags that aren't closed, or not opened, are borne."""
    root = Element("#root", "", None)
    stack, found, pieces = [root], [], []
    owner = root

    def end_block() -> None:
        nonlocal pieces, owner
        if pieces:
            block = Block(owner, pieces)
            if block.text:
                found.append(block)
        pieces = []
        owner = next(e for e in reversed(stack) if e.name not in _INLINE)

    def say(text: str) -> None:
        if text:
            pieces.append((html.unescape(text), stack[-1].links))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:  # an end
            if name not in _INLINE:
                end_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            if name not in _INLINE:
                end_block()
            continue
        if name == "br":
            pieces.append((" ", False))
            continue
        if name not in _INLINE:
            end_block()
            for i in range(len(stack) - 1, 0, -1):  # a block ends the paragraph that is open
                if stack[i].name == "p":
                    del stack[i:]
                    break
                if stack[i].name not in _INLINE:
                    break
            bound = _BOUNDS.get(name, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in bound:
                    break
                if stack[i].name in _ENDS.get(name, ()):
                    del stack[i:]
                    if name not in ("tr", "tbody", "tfoot"):
                        break
            if name == "body" or name in ("div", "article", "main", "nav", "header", "section", "h1", "p"):
                while len(stack) > 1 and any(e.name == "head" for e in stack):  # a head that is never closed
                    stack.pop()
        if name in _VOID:
            if name not in _INLINE:
                end_block()
            continue
        stack.append(Element(name, m[3], stack[-1]))
        if name not in _INLINE:
            owner = stack[-1]
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            say(page[at : end.start() if end else n])
            at = end.end() if end else n
            end_block()
            stack.pop()
            end_block()
    end_block()
    return found


def scores(page: list[Block]) -> dict[tuple[str, ...], float]:
    """For each path of tags the mean of its blocks' fused ratios, over the standard deviation of all blocks."""
    paths = [tuple(e.label for e in b.of.path()) for b in page]
    total: dict[tuple[str, ...], np.ndarray] = {}
    for path, b in zip(paths, page):
        total[path] = total.get(path, 0) + np.array([1.0, b.chars, b.punctuation, min(b.links, b.chars)])
    ratio = np.array([total[p][1:3] / total[p][0] for p in paths])
    own = np.array([1 - total[p][3] / max(total[p][1], 1) for p in paths])
    weight = np.convolve(np.ones(len(page)), KERNEL, "full")[2:-2]
    smooth = [np.convolve(ratio[:, k], KERNEL, "full")[2:-2] / weight for k in (0, 1)]
    # Each path keeps its own ratio as well: smoothing lifts short blocks among long ones, not long ones that stand alone.
    fused = np.maximum(smooth[0], ratio[:, 0]) * (1 + np.maximum(smooth[1], ratio[:, 1])) * own
    deviation = float(fused.std()) or 1.0
    mean: dict[tuple[str, ...], list[float]] = {}
    for path, score in zip(paths, fused):
        mean.setdefault(path, []).append(float(score))
    return {p: sum(x) / len(x) / deviation for p, x in mean.items()}


def main_blocks(page: list[Block]) -> list[Block]:
    """The blocks of the article."""
    left = [b for b in page if not b.of.hinted] or [b for b in page if not b.of.aside]
    if not left:
        return []
    score = scores(left)
    picked = [i for i, b in enumerate(left) if score[tuple(e.label for e in b.of.path())] >= SHARE]
    anchors = sorted({*picked, *(i for i, b in enumerate(left) if b.of.name == "h1")}) or list(range(len(left)))
    named: dict[Element, int] = {}
    for i in picked or anchors:
        if left[i].of.within is not None:
            named[left[i].of.within] = named.get(left[i].of.within, 0) + left[i].chars
    if named and 2 * max(named.values()) >= sum(left[i].chars for i in picked or anchors):
        best = max(named, key=lambda e: named[e])
        return [b for b in left if best in b.of.path()]
    within = [b.of.path() for b in (left[i] for i in anchors)]
    depth = 0
    while all(len(p) > depth + 1 for p in within) and len({p[depth + 1] for p in within}) == 1:
        depth += 1
    region, chosen = within[0][depth], set(picked)
    kept = [(i, b) for i, b in enumerate(left) if anchors[0] <= i <= anchors[-1] and region in b.of.path()]
    return [b for i, b in kept if i in chosen or 2 * b.links <= b.chars]


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by one space."""
    return " ".join(b.text for b in main_blocks(blocks(page or "")))


@F.pandas_udf(StringType())
def _article(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text, na_action=None)


def extract_main_text(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """The columns of `pages` plus `into`, the article of the page in `column`.

    Character references are decoded, white space within a block becomes one space, and blocks are
    joined by one space in the page's order. Defined cases: a null or empty page, and one without
    text outside of what is set aside, give ""; tags that are never closed end with the page;
    repeated rows stay; other columns, of whatever name, pass through (an `into` among them is
    replaced). Each page is read whole, by one task, and by itself.
    """
    quoted = "`" + column.replace("`", "``") + "`"
    return pages.withColumn(into, _article(F.col(quoted)))


def op11_html_extract(spark, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: What the pages of the sample tables hold between the tags of their article, by patterns.
SQL = r"""
WITH bodies AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g') AS body FROM bodies),
decoded AS (
  SELECT page_id, url, regexp_replace(replace(replace(replace(body, '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS body FROM plain),
texts AS (SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""

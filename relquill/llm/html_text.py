"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks of text at its block-level tags. Each block is described by its word count and
link density, those of the block before and after it, and what its open elements say of it (whether it is inside
an article, or inside something marked as not content). A decision tree, grown here from the small
labelled table below, keeps or drops each block. Blocks kept are joined in page order.

Reading takes time linear in the page: what the open elements say is carried along on the stack. Text of drawings
(svg) is markup, text of formulas (math) is not.

Edge cases: null and empty pages give the empty text; unclosed and truncated markup is read as far
as it goes (an unfinished tag at the end is dropped, as browsers do); pages of any length are read whole;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm._shared import prepare, read_table

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<[!?/A-Za-z][^>]*+(?:>|\Z)""",
    re.S,
)
_RAW = ("script", "style", "noscript", "template", "iframe", "svg", "object", "head", "title", "textarea", "canvas", "audio", "video")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in _RAW}
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover q rp semantics rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr p li dt dd option tr td th thead tbody tfoot".split())
_ASIDE = frozenset("nav header footer aside form menu dialog select button fieldset label".split())
#: Elements that hold the content: class names on them ("has-sidebar") tell of the layout, not of what they are.
_WHOLE = frozenset("html body article main".split())
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of class names and ids that say an element isn't content.
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion comment comments commentlist respond reply replies disqus sidebar side "
    "widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead header cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe "
    "signup login search share sharing social related recommended recommendations trending popular toolbar pagination pager tags copyright legal disclaimer hidden skip".split()
)
#: Names by which an element says that it holds the content: a hint that is only part of another of its names is then a detail.
_CONTENT = frozenset("post entry content story article main body text hentry page blog".split())
#: First and last words of names that tell a state or a category ("has-header", "tag-news", "share-enabled"), not what the element is.
_STATE_FIRST = frozenset("has have no not non with without is are tag category cat format status type layout template show hide".split())
_STATE_LAST = frozenset("enabled disabled on off open closed none active visible".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "article", "heading", "has_article")


@dataclass
class Block:
    text: str
    words: int
    links: float
    aside: bool
    article: bool
    heading: bool


@lru_cache(4096)
def _hinted(value: str) -> bool:
    """Whether a class or id says that its element isn't content."""
    names = [[w.lower() for w in _NAME.findall(x)] for x in value.split()]
    content = any("".join(words) in _CONTENT for words in names)
    for words in names:
        if len(words) == 1:
            if words[0] in _HINTS:
                return True
        elif words and not content and words[0] not in _STATE_FIRST and words[-1] not in _STATE_LAST and not _HINTS.isdisjoint(words):
            return True
    return False


def _marked(name: str, attrs: str) -> bool:
    """Whether an element says of itself that it isn't content."""
    if name in _ASIDE:
        return True
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id") and name not in _WHOLE and _hinted(value):
            return True
        if key == "role" and value.lower() in _ROLES:
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's flat text blocks, in order."""
    out: list[Block] = []
    # open elements: name, whether in an article, whether marked since the nearest one, whether headers alone are
    stack: list[tuple[str, bool, bool, bool]] = []
    open_names: Counter[str] = Counter()
    loose: dict[str, int] = {}  # marked elements that need no end tag, and the depth they stand at
    text: list[str] = []
    linked: list[str] = []
    anchor, heading, at = False, False, 0

    def flush() -> None:
        words = "".join(text).split()
        if words:
            _, inner, aside, headers = stack[-1] if stack else ("", False, False, True)
            # what is marked outside the nearest article does not mark the article; its own title may stand in a header
            aside = bool(loose) or aside and not (heading and inner and headers)
            n = len("".join(linked).split())
            out.append(Block(" ".join(words), len(words), min(1.0, n / len(words)), aside, inner, heading))
        text.clear()
        linked.clear()

    while at < len(page):
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            piece = html.unescape(piece)
            text.append(piece)
            if anchor:
                linked.append(piece)
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in _INLINE:
            if name == "a":
                anchor = not m["end"]
            if name in ("br", "img", "wbr"):
                text.append(" " if name == "br" else "")
                if anchor:
                    linked.append(" ")
            continue
        flush()
        if m["end"]:
            heading = False if name in _HEADING else heading
            loose.pop(name, None)
            if name not in _VOID and open_names[name]:
                while True:
                    last = stack.pop()[0]
                    open_names[last] -= 1
                    if last == name:
                        break
                if loose:
                    loose = {x: depth for x, depth in loose.items() if depth <= len(stack)}
            anchor = False
            continue
        if name in _RAW and not (m["attrs"] or "").endswith("/"):
            end = _RAW_END[name].search(page, at)
            if name == "head" and not end:  # a head without an end: what a body begins with ends it
                end = re.compile(r"(?=<body\b)", re.I).search(page, at)
                at = end.end() if end else at
            else:
                at = end.end() if end else len(page)
            continue
        heading = name in _HEADING
        anchor = False
        marked = _marked(name, m["attrs"] or "")
        if name not in _VOID and not (m["attrs"] or "").endswith("/"):
            _, inner, aside, headers = stack[-1] if stack else ("", False, False, True)
            if name in ("article", "main"):
                inner, aside, headers = True, False, True
            stack.append((name, inner, aside or marked, headers and (not marked or name == "header")))
            open_names[name] += 1
        elif name in ("p", "li", "td", "dd"):
            loose.pop(name, None)
            if marked:
                loose[name] = len(stack)
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    x = np.zeros((len(found), len(FEATURES)))
    if not found:
        return x
    x[:, 0] = [b.words for b in found]
    x[:, 1] = [b.links for b in found]
    x[1:, 2:4] = x[:-1, 0:2]
    x[:-1, 4:6] = x[1:, 0:2]
    x[:, 6] = [b.aside for b in found]
    x[:, 7] = [b.article for b in found]
    x[:, 8] = [b.heading for b in found]
    x[:, 9] = any(b.article and not b.aside for b in found)
    return x


#: Labelled blocks: FEATURES, then 1 if the block is main text.
TABLE = (
    # in an article, nothing against them: paragraphs of any length, titles, short lines
    (60, 0.00, 10, 0.00, 45, 0.00, 0, 1, 0, 1, 1), (8, 0.00, 0, 0.00, 60, 0.00, 0, 1, 1, 1, 1), (1, 0.00, 80, 0.00, 4, 0.00, 0, 1, 0, 1, 1),
    (3, 0.00, 2, 0.00, 1, 0.00, 0, 1, 0, 1, 1), (120, 0.05, 30, 0.00, 25, 0.10, 0, 1, 0, 1, 1), (2, 0.00, 90, 0.00, 6, 0.00, 0, 1, 0, 1, 1),
    (25, 0.30, 60, 0.00, 70, 0.00, 0, 1, 0, 1, 1), (12, 0.00, 1, 1.00, 200, 0.00, 0, 1, 1, 1, 1), (40, 0.00, 12, 0.00, 14, 0.10, 0, 1, 0, 1, 1),
    (5, 0.40, 70, 0.00, 50, 0.00, 0, 1, 0, 1, 1), (1, 0.00, 1, 0.00, 9, 0.00, 0, 1, 0, 1, 1), (300, 0.00, 9, 0.00, 11, 0.15, 0, 1, 0, 1, 1),
    # at the ends of a page, or alone on it
    (20, 0.00, 0, 0.00, 0, 0.00, 0, 1, 0, 1, 1), (45, 0.00, 30, 0.00, 0, 0.00, 0, 1, 0, 1, 1), (4, 0.00, 30, 0.00, 0, 0.00, 0, 1, 0, 1, 1),
    (150, 0.00, 0, 0.00, 0, 0.00, 0, 1, 0, 1, 1), (1, 0.00, 12, 0.00, 0, 0.00, 0, 1, 0, 1, 1), (3, 0.00, 0, 0.00, 0, 0.00, 0, 1, 1, 1, 1),
    (50, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 1), (60, 0.00, 45, 0.00, 0, 0.00, 0, 0, 0, 0, 1), (35, 0.05, 20, 0.00, 0, 0.00, 0, 0, 0, 0, 1),
    (20, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0, 1), (40, 0.00, 60, 0.00, 0, 0.00, 0, 0, 0, 1, 0), (15, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1, 0),
    (40, 0.00, 0, 0.00, 0, 0.00, 1, 0, 0, 0, 0), (12, 0.00, 45, 0.00, 0, 0.00, 1, 1, 0, 1, 0), (6, 0.00, 40, 0.00, 0, 0.00, 0, 0, 0, 0, 0),
    # lists of links in an article, such as its references
    (3, 1.00, 2, 1.00, 4, 1.00, 0, 1, 0, 1, 1), (5, 1.00, 60, 0.00, 5, 1.00, 0, 1, 0, 1, 1), (6, 0.90, 4, 1.00, 0, 0.00, 0, 1, 0, 1, 1),
    (2, 1.00, 50, 0.00, 12, 0.00, 0, 1, 0, 1, 1), (9, 0.95, 8, 1.00, 30, 0.00, 0, 1, 0, 1, 1), (1, 1.00, 1, 1.00, 1, 1.00, 0, 1, 0, 1, 1),
    # marked as something else, whatever their size
    (1, 1.00, 0, 0.00, 1, 1.00, 1, 0, 0, 1, 0), (8, 0.00, 1, 1.00, 12, 0.00, 1, 0, 0, 1, 0), (14, 0.10, 50, 0.00, 0, 0.00, 1, 0, 0, 1, 0),
    (60, 0.00, 70, 0.00, 55, 0.00, 1, 1, 0, 1, 0), (45, 0.00, 30, 0.00, 20, 0.00, 1, 0, 0, 1, 0), (5, 0.00, 6, 0.00, 40, 0.00, 1, 1, 1, 1, 0),
    (20, 0.00, 1, 1.00, 9, 0.00, 1, 0, 0, 0, 0), (90, 0.00, 5, 0.00, 0, 0.00, 1, 0, 0, 0, 0), (3, 0.00, 80, 0.00, 2, 1.00, 1, 0, 1, 0, 0),
    (120, 0.05, 100, 0.00, 90, 0.00, 1, 0, 0, 1, 0), (1, 0.00, 2, 0.00, 3, 0.00, 1, 1, 0, 1, 0), (33, 0.30, 12, 0.00, 10, 0.00, 1, 0, 0, 0, 0),
    # outside the article of a page that has one
    (30, 0.00, 1, 1.00, 12, 0.00, 0, 0, 0, 1, 0), (6, 0.00, 80, 0.00, 0, 0.00, 0, 0, 0, 1, 0), (70, 0.00, 60, 0.00, 0, 0.00, 0, 0, 0, 1, 0),
    (4, 1.00, 3, 1.00, 5, 1.00, 0, 0, 0, 1, 0), (9, 0.00, 0, 0.00, 40, 0.00, 0, 0, 1, 1, 0), (2, 0.00, 1, 0.00, 30, 0.00, 0, 0, 0, 1, 0),
    # pages without an article: size and links decide
    (60, 0.00, 1, 1.00, 45, 0.00, 0, 0, 0, 0, 1), (35, 0.10, 60, 0.00, 50, 0.00, 0, 0, 0, 0, 1), (14, 0.00, 40, 0.00, 50, 0.00, 0, 0, 0, 0, 1),
    (9, 0.00, 1, 1.00, 60, 0.00, 0, 0, 1, 0, 1), (5, 0.00, 40, 0.00, 80, 0.00, 0, 0, 1, 0, 1), (20, 0.00, 25, 0.00, 3, 0.50, 0, 0, 0, 0, 1),
    (2, 0.00, 45, 0.00, 38, 0.00, 0, 0, 0, 0, 1), (6, 0.10, 90, 0.00, 30, 0.00, 0, 0, 0, 0, 1), (17, 0.00, 0, 0.00, 18, 0.00, 0, 0, 0, 0, 1),
    (16, 0.05, 12, 0.00, 2, 1.00, 0, 0, 0, 0, 1), (110, 0.25, 2, 1.00, 3, 1.00, 0, 0, 0, 0, 1), (4, 0.00, 22, 0.00, 33, 0.00, 0, 0, 0, 0, 1),
    (1, 1.00, 0, 0.00, 1, 1.00, 0, 0, 0, 0, 0), (3, 1.00, 50, 0.00, 2, 1.00, 0, 0, 0, 0, 0), (4, 0.00, 1, 1.00, 2, 1.00, 0, 0, 0, 0, 0),
    (12, 0.80, 3, 1.00, 9, 0.90, 0, 0, 0, 0, 0), (5, 0.20, 60, 0.00, 0, 0.00, 0, 0, 0, 0, 0), (30, 0.75, 4, 1.00, 12, 0.80, 0, 0, 0, 0, 0),
    (2, 0.50, 2, 1.00, 4, 0.60, 0, 0, 0, 0, 0), (6, 0.00, 3, 1.00, 4, 0.50, 0, 0, 0, 0, 0), (3, 0.00, 2, 0.00, 4, 0.30, 0, 0, 0, 0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12):
    """A decision tree by Gini impurity: (feature, threshold, low, high), or the label."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            p, q = y[low].mean(), y[~low].mean()
            impurity = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


@cache
def tree():
    table = np.array(TABLE, float)
    return grow(table[:, :-1], table[:, -1])


def classify(x: np.ndarray) -> np.ndarray:
    """Whether each row is main text."""
    out = np.zeros(len(x), bool)

    def walk(node, rows: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[rows] = bool(node)
            return
        f, cut, low, high = node
        below = x[rows, f] <= cut
        walk(low, rows[below])
        walk(high, rows[~below])

    walk(tree(), np.arange(len(x)))
    return out


def main_text(page: str | None) -> str:
    """The page's main text, blocks apart by an empty line."""
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, classify(features(found)), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text, n_chars. One pass, no shuffle."""
    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in column], dtype=object)

    out = pages.select(F.col(id_col), F.col(url_col), text(F.col(html_col).cast("string")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract(read_table(spark, sf_dir, "pages"))

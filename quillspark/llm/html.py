"""Main text of web pages: flat text blocks classified by a decision tree over words, link density and neighbours.

A page becomes a flat list of text blocks. Each block has its number of words, its link density, the same
two of its neighbours, and where it stands (inside an article, inside chrome such as a menu, a heading). A
decision tree, grown here from the small labelled table below, says which blocks are main text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._frames import per_batch, pick

_ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+"""
_RAW = "script|style|textarea|title|iframe|noembed|noframes|noscript|template|xmp|svg|math|select|button|object|canvas"
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({_RAW})\b{_ATTRS}>.*?(?:</\1\b[^>]*>|\Z)|<(/?)([a-z][^\s/>]*+)({_ATTRS})>|<[!?/][^>]*>", re.S | re.I)
ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|\b(hidden)\b""")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav footer aside form dialog menu head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
#: Names that say by themselves that an element is no article text.
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup login sidebar aside nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead footer copyright comment comments disqus respond replies reply reader-comments "
    "share sharing widget widgets pagination pager paging skip search".split()
)
#: Names that menus, lists of links and notices have, but parts of articles too: within an article words and link density decide.
HINT_WORDS = frozenset("header menu menus rail notice notices alert alerts legal related recommended recommendations trending popular social tags form".split())
#: Elements of running text: what they are named says nothing within an article.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre li dd dt figcaption caption td th span b i em strong a code mark header".split())
ARTICLE_WORDS = frozenset("article story entry post content main".split())

Block = tuple[str, int, float, bool, bool, bool, bool]  # text, words, link density, in article, in chrome, heading, hint of chrome


def _marks(name: str, attrs: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element is chrome, is an article, and has a name that hints at chrome; ``inside``: it stands in an article."""
    article, chrome, hint = name in ("article", "main"), name in CHROME_TAGS, False
    if attrs and not attrs.isspace() and name not in ("html", "body"):
        for key, a, b, c, hidden in ATTR.findall(attrs):
            key, value = key.lower(), (a or b or c).lower()
            if hidden or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                chrome = True
            elif key == "role":
                chrome |= value in CHROME_ROLES
                article |= value in ("main", "article")
            elif key in ("class", "id") and name not in ("article", "main"):
                words = set(re.split(r"[^a-z0-9]+", value))
                if not (inside and name in TEXT_TAGS):
                    chrome |= bool(words & CHROME_WORDS) or not inside and bool(words & HINT_WORDS)
                    hint |= inside and bool(words & HINT_WORDS)
                article |= bool(words & ARTICLE_WORDS) and name in ("div", "section", "td")
    return chrome, article, hint


def blocks(html: str) -> list[Block]:
    """The page's flat text blocks in order; character references decoded, white space made one space."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, chrome, article, hint
    chrome = article = links = heading = hints = 0
    text: list[str] = []
    linked: list[str] = []

    def close(at: int) -> None:
        nonlocal chrome, article, links, heading, hints
        for name, c, a, h in stack[at:]:
            chrome -= c
            article -= a
            hints -= h
            links -= name == "a"
            heading -= name[0] == "h" and name[1:].isdigit()
        del stack[at:]

    def flush() -> None:
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                n, m = whole.count(" ") + 1, len("".join(linked).split())
                out.append((whole, n, min(1.0, m / n), article > 0, chrome > 0, heading > 0, hints > 0))
            text.clear()
            linked.clear()

    def say(run: str) -> None:
        if "&" in run:
            run = unescape(run)
        text.append(run)
        if links:
            linked.append(run + " ")

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        block = name in BLOCK
        if block:
            flush()
        elif name == "br":
            text.append(" ")
            continue
        if m.group(2):
            floor = len(stack)
            while floor and stack[floor - 1][0] != name:
                if not block and stack[floor - 1][0] in BLOCK:
                    floor = 0
                    break
                floor -= 1
            if floor:
                if block:
                    close(floor - 1)
                else:
                    rest = stack[floor:]
                    close(floor - 1)
                    for x in rest:
                        stack.append(x)
                        chrome, article, hints = chrome + x[1], article + x[2], hints + x[3]
                        links += x[0] == "a"
            continue
        if name in VOID:
            continue
        if block:
            # a paragraph ends at the next block, a list item at the next item
            for i in range(len(stack) - 1, -1, -1):
                open_name = stack[i][0]
                if open_name == "p" or open_name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    close(i)
                    break
                if open_name in BLOCK:
                    break
        is_chrome, is_article, is_hint = _marks(name, m.group(4), article > 0)
        if name == "header" and not article:
            is_chrome = True
        stack.append((name, is_chrome, is_article, is_hint))
        chrome, article, hints = chrome + is_chrome, article + is_article, hints + is_hint
        links += name == "a"
        heading += name[0] == "h" and name[1:].isdigit()
    if at < len(html):
        say(html[at:])
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row a block: words, link density, those of the block before and after, article, chrome, heading, page has an article, hint of chrome."""
    n = len(found)
    x = np.zeros((n, 11))
    if n:
        x[:, 0], x[:, 1] = [b[1] for b in found], [b[2] for b in found]
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
        x[:, 6], x[:, 7], x[:, 8] = [b[3] for b in found], [b[4] for b in found], [b[5] for b in found]
        x[:, 9] = float(any(b[3] and not b[4] for b in found))
        x[:, 10] = [b[6] for b in found]
    return x


#: Labelled blocks: words and link density of a block, of the one before, of the one after; whether it is a heading; and whether
#: it is main text, in turn for: within an article; there, in a part whose name hints at chrome; on a page without an article.
LABELLED = """
60 0 9 0 45 0  0 111; 1 0 0 0 60 0  1 111; 9 0 0 0 80 .02  1 111; 210 .01 40 0 0 0  0 111; 4 1 50 0 70 0  0 100; 12 .5 80 0 33 .1  0 100
33 .05 5 1 12 0  0 111; 2 1 3 1 4 1  0 100; 3 1 0 0 2 1  0 100; 4 1 3 1 0 0  0 100; 6 .83 40 0 5 1  0 100; 3 0 45 0 4 1  0 100
14 0 3 1 9 0  0 111; 40 0 0 0 9 0  0 111; 90 0 60 0 70 0  0 111; 7 0 4 1 6 1  0 100; 20 .9 6 1 8 1  0 100; 5 0 2 1 90 0  1 111
30 0 60 0 3 1  0 111; 2 0 60 0 45 0  1 111; 25 .3 35 0 30 0  0 111; 8 .5 3 1 60 0  0 100; 6 0 3 1 4 1  0 100; 120 0 2 1 4 1  0 111
8 0 70 0 60 0  0 111; 1 0 60 0 45 0  0 111; 3 0 0 0 0 0  0 111; 45 .1 20 0 2 1  0 111; 1 1 60 0 1 1  0 100; 4 0 3 1 5 1  0 100
12 .7 30 0 9 1  0 100; 5 0 0 0 3 1  0 100; 64 0 4 1 50 0  0 111; 2 1 0 0 0 0  0 100; 17 0 30 .2 11 .1  0 111; 4 0 3 1 2 1  1 100
"""
#: The marks (article, chrome, page has an article, hint of chrome) of those three places, and of those where no block is main text.
MARKS = ((1, 0, 1, 0), (1, 0, 1, 1), (0, 0, 0, 0)), ((0, 0, 1, 0), (0, 1, 1, 0), (1, 1, 1, 0), (1, 1, 1, 1), (0, 1, 0, 0))


class Tree:
    """A classification tree grown by Gini impurity; ``None`` splits are leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8) -> None:
        self.value, self.feature, self.cut = int(2 * y.sum() >= len(y)), None, 0.0
        if depth == 0 or y.min() == y.max():
            return
        best = None
        for f in range(x.shape[1]):
            seen = np.unique(x[:, f])
            for cut in (seen[1:] + seen[:-1]) / 2:
                low = x[:, f] <= cut
                score = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if best is None or score < best[0] - 1e-12:
                    best = (score, f, cut)
        if best is None:
            return
        _, self.feature, self.cut = best
        low = x[:, self.feature] <= self.cut
        self.below, self.above = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.value)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x), np.int64)
        out[low], out[~low] = self.below.predict(x[low]), self.above.predict(x[~low])
        return out


@lru_cache(1)
def trained() -> Tree:
    x, y = labelled()
    return Tree(x, y)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features and labels."""
    x, y = [], []
    for block in LABELLED.strip().replace("\n", ";").split(";"):
        *numbers, heading, labels = block.split()
        for marks, label in [*zip(MARKS[0], labels, strict=True), *((m, "0") for m in MARKS[1])]:
            article, chrome, has, hint = marks
            x.append([*map(float, numbers), article, chrome, float(heading), has, hint])
            y.append(int(label))
    return np.array(x), np.array(y)


def main_text(html: str) -> str:
    found = blocks(html)
    if not found:
        return ""
    keep = trained().predict(features(found))
    return " ".join(b[0] for b, k in zip(found, keep, strict=True) if k)


SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; null and empty html, and pages without main text, give ''.

    Unclosed tags, comments and scripts end with the page; repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty one. Narrow: no shuffle.
    """

    def build():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) if h else "" for h in b.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=SCHEMA.names)

        return step

    return pick(pages, page_id=id_col, url=url_col, html=html_col).mapInArrow(per_batch(build), SCHEMA)

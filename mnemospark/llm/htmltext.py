"""Main-text extraction from HTML: flat text blocks judged by a small decision tree.

A page becomes a flat list of text blocks (text between block-level tags). Each block has its
word count and link density, those of its neighbours, and its place: inside an article, in
a container that is named or marked as menu, advert, comment and the like, or neither. A
decision tree, trained on the labelled table below, keeps or drops each block.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by one newline in page order. Equal pages give equal texts, and repeated rows are read like others; a tie of two splits of
the tree goes to the feature that comes first. An empty table gives no rows. Columns named like the new ones are replaced; pages of any
length are read whole. Nulls, empty pages and pages without text give an
empty string. Broken markup never raises: an unclosed comment, script or style reaches to
the page's end, a "<" that opens no tag is text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mnemospark.llm.common import append_columns

_TAG = re.compile(r"<(?:!--|(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*+)>|[!?][^>]*>)")
_CUT = re.compile(r"<[A-Za-z/!?]")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose text is never shown as text.
UNSEEN = frozenset("script style noscript template svg math iframe object head title select textarea button canvas audio video datalist".split())
BREAKS = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside "
    "blockquote pre figure figcaption form fieldset legend hr address body html details summary center menu dialog option".split()
)
CONTAINERS = frozenset("div section article main header footer nav aside form ul ol dl table figure fieldset menu dialog body span p li details".split())
SPACES = frozenset("br wbr td th img input".split())
DROPPED = frozenset("nav aside footer form menu dialog".split())
#: Parts of class, id and role names that mark what surrounds an article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe subscription signup login search form widget pagination pager toolbar tags "
    "copyright disclaimer legal skip contentinfo complementary dialog alertdialog".split()
)
#: Parts that say where or how something stands, not what it is: a class word is marked if its other parts all are.
NEUTRAL = frozenset(
    "site page main top bottom left right primary secondary global inner outer box wrap wrapper container block list area bar section item items link links "
    "button buttons text content title heading body group module panel post article entry user reader the js has is sticky fixed floating and of"
    .split()
)
#: Of the marked parts, the ones that still hold for an article inside them.
STRONG = frozenset("comment comments disqus respond reply replies related recommended".split())
OPEN, ARTICLE, CONTENT, OUTSIDE, MARK = 1, 3, 2, 0, -1

#: The labelled table: words, link density, words and density of the block before and after,
#: place, and whether the block belongs to the main text.
LABELLED = [
    # long and short paragraphs and headings of an article
    (60, 0.0, 55, 0.0, 70, 0.0, ARTICLE, 1), (8, 0.0, 2, 1.0, 60, 0.0, ARTICLE, 1), (1, 0.0, 40, 0.0, 45, 0.0, ARTICLE, 1),
    (2, 0.0, 1, 0.0, 1, 0.0, ARTICLE, 1), (12, 0.0, 9, 0.0, 0, 0.0, ARTICLE, 1), (25, 0.2, 60, 0.0, 3, 1.0, ARTICLE, 1),
    (30, 0.5, 50, 0.1, 60, 0.0, ARTICLE, 1), (5, 1.0, 60, 0.0, 55, 0.0, ARTICLE, 1), (3, 0.0, 4, 1.0, 12, 0.3, ARTICLE, 1),
    (200, 0.02, 0, 0.0, 9, 0.6, ARTICLE, 1), (4, 0.0, 0, 0.0, 0, 0.0, ARTICLE, 1), (6, 0.3, 9, 0.0, 9, 0.0, ARTICLE, 1),
    (15, 0.8, 40, 0.0, 38, 0.0, ARTICLE, 1), (1, 0.0, 1, 1.0, 7, 0.5, ARTICLE, 1), (9, 0.0, 5, 1.0, 4, 1.0, ARTICLE, 1),
    # rows of links inside an article are its text, as a list of works or sources is
    (3, 1.0, 4, 1.0, 2, 1.0, ARTICLE, 1), (6, 1.0, 5, 1.0, 30, 0.0, ARTICLE, 1), (7, 1.0, 8, 1.0, 6, 1.0, ARTICLE, 1),
    (2, 1.0, 1, 1.0, 1, 1.0, ARTICLE, 1), (12, 1.0, 14, 1.0, 11, 1.0, ARTICLE, 1),
    # content that is only named as such
    (50, 0.0, 40, 0.0, 45, 0.0, CONTENT, 1), (2, 0.0, 44, 0.0, 38, 0.0, CONTENT, 1), (1, 0.0, 2, 0.0, 1, 0.0, CONTENT, 1),
    (9, 0.1, 3, 1.0, 50, 0.0, CONTENT, 1), (18, 0.6, 35, 0.0, 20, 0.1, CONTENT, 1), (4, 1.0, 3, 1.0, 5, 1.0, CONTENT, 0),
    (9, 1.0, 8, 1.0, 7, 1.0, CONTENT, 0), (6, 1.0, 40, 0.0, 30, 0.0, CONTENT, 1), (11, 0.0, 0, 0.0, 0, 0.0, CONTENT, 1),
    # whatever is in marked containers
    (60, 0.0, 55, 0.0, 50, 0.0, MARK, 0), (7, 0.0, 1, 1.0, 8, 0.0, MARK, 0), (1, 1.0, 1, 1.0, 1, 1.0, MARK, 0),
    (9, 0.1, 50, 0.0, 0, 0.0, MARK, 0), (30, 0.0, 3, 0.0, 60, 0.0, MARK, 0), (120, 0.0, 80, 0.0, 20, 0.0, MARK, 0),
    (3, 0.0, 12, 0.0, 25, 0.0, MARK, 0), (15, 0.5, 20, 0.4, 4, 1.0, MARK, 0), (1, 0.0, 60, 0.0, 60, 0.0, MARK, 0),
    # unmarked blocks beside an article
    (2, 1.0, 1, 1.0, 2, 1.0, OUTSIDE, 0), (8, 0.0, 2, 1.0, 7, 0.0, OUTSIDE, 0), (9, 0.2, 60, 0.0, 0, 0.0, OUTSIDE, 0),
    (40, 0.0, 50, 0.0, 10, 0.0, OUTSIDE, 0), (1, 0.0, 0, 0.0, 1, 0.0, OUTSIDE, 0), (20, 0.4, 30, 0.0, 5, 1.0, OUTSIDE, 0),
    # pages with no article: long blocks, and short ones by their neighbours
    (60, 0.0, 55, 0.0, 50, 0.0, OPEN, 1), (45, 0.05, 2, 1.0, 38, 0.0, OPEN, 1), (38, 0.0, 40, 0.0, 3, 1.0, OPEN, 1),
    (100, 0.1, 0, 0.0, 0, 0.0, OPEN, 1), (22, 0.0, 30, 0.0, 25, 0.1, OPEN, 1), (18, 0.0, 6, 0.0, 40, 0.0, OPEN, 1),
    (12, 0.0, 35, 0.0, 28, 0.0, OPEN, 1), (6, 0.0, 2, 1.0, 50, 0.0, OPEN, 1), (3, 0.0, 48, 0.0, 52, 0.0, OPEN, 1),
    (2, 0.0, 30, 0.0, 33, 0.0, OPEN, 1), (8, 0.1, 25, 0.0, 9, 0.0, OPEN, 1), (14, 0.2, 20, 0.0, 0, 0.0, OPEN, 1),
    (9, 0.0, 8, 0.0, 40, 0.0, OPEN, 1), (30, 0.25, 40, 0.0, 35, 0.0, OPEN, 1), (1, 0.0, 40, 0.0, 20, 0.0, OPEN, 1),
    (1, 1.0, 1, 1.0, 2, 1.0, OPEN, 0), (3, 1.0, 2, 1.0, 40, 0.0, OPEN, 0), (5, 1.0, 45, 0.0, 4, 1.0, OPEN, 0),
    (2, 0.0, 1, 1.0, 1, 1.0, OPEN, 0), (4, 0.5, 3, 1.0, 2, 1.0, OPEN, 0), (9, 0.9, 8, 1.0, 60, 0.0, OPEN, 0),
    (12, 0.8, 10, 0.9, 11, 0.9, OPEN, 0), (20, 0.7, 15, 0.8, 18, 0.9, OPEN, 0), (3, 0.0, 2, 0.0, 1, 0.0, OPEN, 0),
    (6, 0.0, 3, 0.0, 0, 0.0, OPEN, 0), (5, 0.0, 1, 1.0, 4, 0.0, OPEN, 0), (7, 0.4, 5, 0.5, 6, 0.6, OPEN, 0),
    (10, 0.6, 50, 0.0, 0, 0.0, OPEN, 0), (4, 0.0, 6, 0.9, 0, 0.0, OPEN, 0), (25, 0.6, 3, 1.0, 4, 1.0, OPEN, 0),
    # a page's only block
    (1, 0.0, 0, 0.0, 0, 0.0, OPEN, 1), (9, 0.0, 0, 0.0, 0, 0.0, OPEN, 1), (20, 0.1, 0, 0.0, 0, 0.0, OPEN, 1), (3, 1.0, 0, 0.0, 0, 0.0, OPEN, 0),
]


def blocks_of(page: str | None) -> list[tuple[str, int, int, int]]:
    """(text, words, words in links, place) of each text block, in page order."""
    page = page or ""
    out: list[tuple[str, int, int, int]] = []
    # open containers: name, what it says of its inside, the place that results, whether in an article
    stack: list[tuple[str, int | None, int, bool]] = []
    opened: Counter[str] = Counter()
    endless: set[str] = set()
    last = page.rfind(">") + 1  # behind the last ">" no tag can end
    pieces: list[str] = []
    linked, in_link, at, seen_article = 0, False, 0, False

    def place() -> int:
        return max(MARK, stack[-1][2]) if stack else OPEN

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, text.count(" ") + 1, linked, place()))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text)  # each run of text by itself: a tag ends a character reference
            pieces.append(text)
            if in_link:
                linked += len(text.split())

    while True:
        m = _TAG.search(page, at, last) if at < last else None
        if m is None:
            add(_CUT.split(page[at:], maxsplit=1)[0])  # a tag or comment that never ends is no text
            break
        add(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            if end < 0:
                break
            at = end + 3
            continue
        name = (m[2] or "").lower()
        if not name:
            continue
        closing = bool(m[1])
        if name in UNSEEN and not closing:
            if not m[3].endswith("/"):
                end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if end is None:
                    endless.add(name)
                # an unclosed head or title ends where the next tag begins
                at = end.end() if end else at if name in ("head", "title") else len(page)
            pieces.append(" ")
            continue
        if name in BREAKS:
            end_block()
        elif name in SPACES:
            pieces.append(" ")
        if name == "a":
            in_link = not closing
        if name in CONTAINERS:
            if closing and opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if any(x[1] is not None for x in stack[k:]):
                    end_block()
                opened.subtract(x[0] for x in stack[k:])
                del stack[k:]
                in_link = in_link and name == "span"
            elif not closing and not m[3].endswith("/"):
                _, _, around, inside = stack[-1] if stack else ("", None, OPEN, False)
                says = meaning(name, m[3], inside)
                if says is not None:
                    end_block()
                seen_article = seen_article or says == ARTICLE
                if name not in ("p", "li", "span") or says is not None:
                    holds = says is None or around == MARK - 1 or around == MARK and says == CONTENT
                    stack.append((name, says, around if holds else says, inside or name in ("article", "main")))
                    opened[name] += 1
    end_block()
    if seen_article:
        out = [(t, n, k, OUTSIDE if p == OPEN else p) for t, n, k, p in out]
    return out


def meaning(name: str, attributes: str, inside: bool) -> int | None:
    """What a container says of its inside; MARK - 1 is a mark that no article in it lifts."""
    parts: set[str] = set()
    if attributes:
        for key, value in _NAMED.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                return MARK - 1
            if key in ("class", "id", "role"):
                for word in value.split():
                    own = {x.lower() for x in _PARTS.findall(word)}
                    # "cookie-banner" and "site-footer" are marked, "social-history" is not
                    parts |= own if not own & MARKED or own <= MARKED | NEUTRAL else own - MARKED
    if parts & STRONG or name in DROPPED:
        return MARK - 1
    if name == "body":
        return None
    if name in ("article", "main") or "main" in parts and "role" in attributes:
        return ARTICLE
    if parts & MARKED and not (inside and parts & {"header", "tags"}):
        return MARK
    if name == "header" and not inside:
        return MARK
    if parts & {"article", "content", "entry", "post", "story"} and not inside:
        return CONTENT
    return None


# --- the decision tree ------------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, depth: int = 0):
    """A tree of (feature, bound, at most, above), split by Gini impurity; leaves are labels."""
    if depth == 10 or len(set(y.tolist())) == 1:
        return int(y.mean() >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= bound
            impurity = sum(part.sum() * (1 - y[part].mean() ** 2 - (1 - y[part].mean()) ** 2) for part in (low, ~low))
            if best is None or impurity < best[0] - 1e-9:
                best = (impurity, f, float(bound), low)
    if best is None:
        return int(y.mean() >= 0.5)
    _, f, bound, low = best
    return (f, bound, grow(x[low], y[low], depth + 1), grow(x[~low], y[~low], depth + 1))


def train() -> tuple | int:
    """The tree learned from the labelled table."""
    rows = np.array(LABELLED, float)
    place = rows[:, 6]
    x = np.column_stack([place, rows[:, :6], np.maximum(rows[:, 2], rows[:, 4]), np.minimum(rows[:, 3], rows[:, 5])])
    return grow(x, rows[:, 7].astype(int))


def main_text(page: str | None, tree: tuple | int) -> str:
    """The kept blocks of a whole page, joined by newlines."""
    blocks = blocks_of(page)
    shape = [(0, 0.0), *((n, min(1.0, k / n)) for _, n, k, _ in blocks), (0, 0.0)]
    kept = []
    for i, (text, _, _, where) in enumerate(blocks):
        (pn, pd), (n, d), (nn, nd) = shape[i : i + 3]
        x = (where, n, d, pn, pd, nn, nd, max(pn, nn), min(pd, nd))
        node = tree
        while not isinstance(node, int):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        if node:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, keep: list[str], html_column: str = "html") -> DataFrame:
    """``keep`` with ``text`` and ``n_chars`` (code points) of every row's main text."""
    tree = train()

    def make():
        def run(texts):
            got = [main_text(t, tree) for t in texts]
            return [[g.encode("utf-8", "replace").decode() for g in got], [len(g) for g in got]]

        return run

    return append_columns(pages, html_column, keep, [("text", T.StringType()), ("n_chars", T.LongType())], make)

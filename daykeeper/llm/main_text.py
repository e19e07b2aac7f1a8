"""Main text of web pages: flat text blocks, judged by a decision tree on their and their neighbours' shape."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_HINT = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

# Element names of HTML by their part in a page, and words that name a part in a class or id.
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe"}
_UNSEEN = _RAW | {"template", "svg", "select", "option", "button", "object"}
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp",
    "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_NESTED = {"div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "body", "figure", "details", "dialog", "fieldset", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
_SIDE = {"nav", "footer", "aside", "form", "dialog", "fieldset"}
_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "reply", "replies", "disqus", "respond", "share", "sharing", "social", "related", "recommended",
    "widget", "form", "search", "login", "pagination", "pager", "toolbar", "copyright", "legal", "disclaimer", "complementary", "contentinfo", "tags", "trending",
}

#: Words that say that the named part is left out, and words for the place or kind of a box: a class that ends
#: in one of these is named by its first word, any other by its last (tags-page is a page, page-tags are tags).
_WITHOUT = {"has", "no", "not", "with", "without", "is", "hide", "hidden"}
_BOXES = {
    "area", "bar", "block", "bottom", "box", "buttons", "cell", "col", "column", "container", "content", "group", "holder", "inner", "item", "items", "left", "link", "links", "list",
    "main", "outer", "panel", "posts", "right", "row", "section", "site", "slot", "text", "top", "unit", "wrap", "wrapper", "zone",
}
_COMMENTS = {"comment", "comments", "reply", "replies", "disqus", "respond"}


@dataclass
class Block:
    text: str = ""
    linked: int = 0
    words: int = 0
    inside: bool = False
    side: bool = False
    heading: bool = False
    parts: tuple[int, ...] = ()


@dataclass
class _Open:
    name: str
    inside: bool
    side: bool
    parts: tuple[int, ...] = ()


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    #: Of every container with a side part's name: whether it is named for comments; which hold an article.
    named: list[bool] = field(default_factory=list)
    wraps: set[int] = field(default_factory=set)
    link: int = 0

    def close_block(self) -> None:
        if not self.parts:
            return
        text = " ".join(unescape("".join([p for p, _ in self.parts])).split())
        if text:
            linked = sum(len(p.split()) for p, in_link in self.parts if in_link)
            top = self.stack[-1] if self.stack else _Open("", False, False)
            heading = any(o.name in ("h1", "h2", "h3", "h4", "h5", "h6") for o in self.stack[-2:])
            self.blocks.append(Block(text, linked, max(1, len(text.split())), top.inside, top.side, heading, top.parts))
        self.parts = []


def _side_words(attributes: str) -> set[str]:
    """The words by which class, id, role or label name a side part."""
    found = set()
    for value in _HINT.findall(attributes):
        for name in value.strip("\"'").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
            if not words or _WITHOUT.intersection(words):
                continue
            head = words[-1] if words[-1] not in _BOXES else words[0]
            if head in _WORDS:
                found.add(head)
    return found


def _closing(html: str, name: str, at: int) -> int:
    """Where the unseen element that begins before ``at`` ends. A raw text element without end tag hides the rest
    of the page, as in browsers; of another, or one that the next of its kind follows first, just the tag is unseen."""
    for m in re.compile(rf"<(/?){re.escape(name)}\b[^>]*(?:>|\Z)", re.I).finditer(html, at):
        if m[1]:
            return m.end()
        if name not in _RAW:
            return at
    return len(html) if name in _RAW else at


_LINK_TAG = re.compile(r"<(/?)a\b", re.I)


def text_blocks(html: str) -> list[Block]:
    """The page's blocks in order: text between block-level tags, with white space made single.

    Comments, scripts, styles and other unseen elements give none. A link goes on over blocks until its
    end tag; one without ends with its block. A container named as a side part by its class or id is a
    wrapper and not a side part where it holds an article or main element, or more than half of the
    page's words and is not named for comments. A tag that is cut off by the end of the page is dropped.
    """
    out, at = _Reader(), 0
    while at < len(html):
        m = _MARKUP.search(html, at)
        end = m.start() if m else len(html)
        if end > at:
            out.parts.append((html[at:end], out.link > 0))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in _UNSEEN:
            if not closing and not m[3].endswith("/"):
                at = _closing(html, name, at)
            continue
        if name in _INLINE:
            if name == "a":
                # 2: the end tag comes before the next link, so the link reaches over blocks.
                after = None if closing else _LINK_TAG.search(html, at)
                out.link = 0 if closing else 2 if after and after[1] else 1
            continue
        out.close_block()
        out.link = out.link if out.link == 2 else 0
        if name not in _NESTED:
            continue
        if closing:
            for k in range(len(out.stack) - 1, -1, -1):
                if out.stack[k].name == name:
                    del out.stack[k:]
                    break
        else:
            top = out.stack[-1] if out.stack else _Open("", False, False)
            own = name in ("article", "main")
            if own:
                for k in top.parts:
                    out.wraps.add(k)
            marked = name in ("nav", "footer", "aside") or (name == "header" and not top.inside)
            parts = top.parts
            words = _side_words(m[3]) if m[3] and not own and not marked and name != "body" else set()
            if words or (name in _SIDE and not marked):
                parts = (*parts, len(out.named))
                out.named.append(bool(words & _COMMENTS))
            out.stack.append(_Open(name, top.inside or own, top.side or marked, parts))
    out.close_block()
    _settle(out)
    return out.blocks


def _settle(out: _Reader) -> None:
    """Marks the blocks in named containers that are side parts."""
    held = [0] * len(out.named)
    for block in out.blocks:
        for k in block.parts:
            held[k] += block.words
    total = sum(b.words for b in out.blocks)
    side = [k not in out.wraps and (comments or 2 * held[k] <= total) for k, comments in enumerate(out.named)]
    for block in out.blocks:
        block.side = block.side or any(side[k] for k in block.parts)


#: What the tree sees of a block.
COLUMNS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "side", "heading", "article_on_page")


def table_of(blocks: list[Block]) -> np.ndarray:
    """One row per block; a page's first and last block have empty neighbours."""
    words = np.array([0, *[b.words for b in blocks], 0], float)
    links = np.array([0, *[min(1.0, b.linked / b.words) for b in blocks], 0], float)
    flags = np.array([[b.inside, b.side, b.heading] for b in blocks], float).reshape(-1, 3)
    page = np.full((len(blocks), 1), float(any(b.inside and not b.side for b in blocks)))
    near = np.stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:]], axis=1)
    return np.hstack([near, flags, page])


#: Pages to learn from: (part of the page that wins, its blocks' words / link words / main or not). A page
#: is a list of blocks (inside, side, heading, words, linked words, is main text).
LABELLED = [
    # an article element with menu, advert, short and long paragraphs, footer
    [(0, 1, 0, 2, 2, 0), (0, 1, 0, 1, 1, 0), (0, 1, 0, 1, 1, 0), (0, 1, 0, 12, 0, 0), (1, 0, 1, 8, 0, 1), (1, 0, 0, 2, 0, 1), (1, 0, 0, 90, 0, 1), (1, 0, 0, 1, 0, 1), (0, 1, 0, 14, 0, 0)],
    [(0, 1, 0, 1, 1, 0), (0, 1, 0, 40, 0, 0), (1, 0, 1, 3, 0, 1), (1, 0, 0, 60, 6, 1), (1, 1, 0, 30, 2, 0), (1, 0, 0, 4, 0, 1), (1, 1, 0, 12, 1, 0), (0, 0, 0, 30, 0, 0), (0, 1, 0, 9, 2, 0)],
    [(0, 0, 0, 5, 5, 0), (0, 0, 0, 25, 0, 0), (1, 0, 0, 3, 3, 1), (1, 0, 0, 200, 1, 1), (1, 0, 0, 1, 1, 1), (0, 1, 0, 55, 0, 0), (0, 0, 0, 7, 0, 0)],
    # side parts between and before long paragraphs, short and linked text inside an article
    [(0, 1, 0, 12, 0, 0), (1, 0, 1, 14, 0, 1), (1, 0, 0, 120, 0, 1), (1, 1, 0, 45, 0, 0), (1, 0, 0, 80, 0, 1), (1, 0, 0, 5, 4, 1), (1, 0, 0, 35, 30, 1), (1, 0, 0, 100, 0, 1), (0, 1, 0, 40, 0, 0)],
    [(0, 1, 0, 1, 1, 0), (0, 1, 0, 70, 0, 0), (1, 0, 1, 20, 0, 1), (1, 0, 0, 3, 0, 1), (1, 0, 0, 2, 0, 1), (1, 0, 0, 1, 0, 1), (1, 1, 0, 100, 3, 0), (1, 0, 0, 300, 0, 1), (0, 1, 0, 25, 1, 0)],
    [(0, 1, 0, 6, 0, 0), (1, 0, 0, 40, 0, 1), (1, 1, 0, 4, 0, 0), (1, 0, 0, 50, 0, 1), (1, 1, 0, 60, 20, 0), (1, 0, 0, 1, 0, 1), (0, 1, 0, 18, 0, 0), (0, 1, 0, 120, 0, 0), (0, 1, 0, 2, 2, 0)],
    [(0, 1, 0, 80, 0, 0), (0, 1, 0, 60, 0, 0), (0, 0, 1, 6, 0, 1), (0, 0, 0, 90, 0, 1), (0, 1, 0, 30, 0, 0), (0, 0, 0, 110, 3, 1), (0, 1, 0, 75, 0, 0), (0, 1, 0, 60, 1, 0)],
    # pages that end with their article, or hold nothing else
    [(1, 0, 0, 50, 0, 1)],
    [(1, 0, 0, 2, 0, 1)],
    [(0, 1, 0, 2, 2, 0), (0, 1, 0, 12, 0, 0), (1, 0, 1, 5, 0, 1), (1, 0, 0, 30, 0, 1), (1, 0, 0, 2, 0, 1)],
    [(0, 1, 0, 2, 2, 0), (1, 0, 1, 15, 0, 1), (1, 0, 0, 70, 0, 1), (1, 0, 0, 45, 40, 1)],
    [(0, 0, 0, 3, 3, 0), (1, 0, 0, 4, 0, 1), (1, 0, 0, 6, 5, 1), (0, 0, 0, 5, 5, 0), (0, 0, 0, 8, 0, 0)],
    [(0, 0, 0, 60, 0, 1)],
    [(0, 0, 0, 3, 3, 0), (0, 0, 0, 90, 1, 1), (0, 0, 0, 70, 1, 1)],
    # teasers that are links as a whole, behind the text
    [(0, 1, 0, 2, 2, 0), (0, 0, 1, 2, 0, 1), (0, 0, 0, 60, 0, 1), (0, 0, 0, 40, 0, 1), (0, 0, 1, 3, 3, 0), (0, 0, 0, 8, 8, 0), (0, 0, 0, 6, 6, 0)],
    [(0, 0, 1, 4, 0, 1), (0, 0, 0, 35, 1, 1), (0, 0, 0, 25, 0, 1), (0, 0, 0, 12, 12, 0), (0, 0, 0, 30, 30, 0), (0, 0, 0, 9, 9, 0), (0, 1, 0, 4, 2, 0)],
    # no article element: long text without links is main, as is a short block between such
    [(0, 1, 0, 2, 2, 0), (0, 0, 0, 3, 3, 0), (0, 0, 1, 7, 0, 1), (0, 0, 0, 80, 2, 1), (0, 0, 0, 6, 0, 1), (0, 0, 0, 70, 0, 1), (0, 1, 0, 60, 0, 0), (0, 0, 0, 4, 4, 0)],
    [(0, 0, 0, 1, 1, 0), (0, 0, 0, 2, 2, 0), (0, 0, 0, 12, 11, 0), (0, 0, 1, 5, 0, 1), (0, 0, 0, 45, 0, 1), (0, 0, 0, 22, 1, 1), (0, 1, 0, 35, 0, 0), (0, 0, 0, 5, 2, 0)],
    [(0, 0, 0, 4, 3, 0), (0, 0, 0, 3, 0, 0), (0, 0, 0, 2, 2, 0), (0, 0, 0, 150, 4, 1), (0, 0, 0, 18, 0, 1), (0, 0, 0, 40, 0, 1), (0, 0, 0, 3, 0, 0), (0, 0, 0, 6, 5, 0)],
    [(0, 0, 0, 30, 28, 0), (0, 0, 1, 6, 0, 1), (0, 0, 0, 33, 0, 1), (0, 0, 0, 9, 0, 1), (0, 0, 0, 28, 0, 1), (0, 1, 0, 16, 0, 0), (0, 0, 0, 2, 1, 0)],
    [(0, 0, 0, 3, 3, 0), (0, 0, 0, 4, 0, 0), (0, 0, 0, 2, 2, 0), (0, 1, 0, 90, 0, 0), (0, 1, 1, 4, 0, 0), (0, 0, 0, 5, 5, 0)],
]


@dataclass
class Tree:
    column: int = -1
    limit: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    main: bool = False

    def judge(self, rows: np.ndarray) -> np.ndarray:
        if self.column < 0:
            return np.full(len(rows), self.main)
        left = rows[:, self.column] <= self.limit
        out = np.empty(len(rows), bool)
        out[left] = self.low.judge(rows[left])
        out[~left] = self.high.judge(rows[~left])
        return out


def grow(rows: np.ndarray, truth: np.ndarray, depth: int = 7, least: int = 1) -> Tree:
    """A binary tree by Gini impurity; ties go to the column named first and the lower limit."""
    share = truth.mean() if len(truth) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return Tree(main=bool(share >= 0.5))
    best = (2 * share * (1 - share) * len(truth) - 1e-9, -1, 0.0)
    for column in range(rows.shape[1]):
        values = np.unique(rows[:, column])
        for limit in (values[1:] + values[:-1]) / 2:
            left = rows[:, column] <= limit
            if least <= left.sum() <= len(left) - least:
                cost = sum(2 * len(t) * t.mean() * (1 - t.mean()) for t in (truth[left], truth[~left]))
                if cost < best[0] - 1e-9:
                    best = (cost, column, float(limit))
    if best[1] < 0:
        return Tree(main=bool(share >= 0.5))
    left = rows[:, best[1]] <= best[2]
    return Tree(best[1], best[2], grow(rows[left], truth[left], depth - 1), grow(rows[~left], truth[~left], depth - 1))


@lru_cache(maxsize=1)
def trained() -> Tree:
    rows, truth = [], []
    for page in LABELLED:
        rows.append(table_of([Block("", linked, words, bool(i), bool(s), bool(h)) for i, s, h, words, linked, _ in page]))
        truth += [bool(b[5]) for b in page]
    return grow(np.vstack(rows), np.array(truth))


def main_text(html: str | None, tree: Tree | None = None) -> str:
    blocks = text_blocks(html or "")
    if not blocks:
        return ""
    keep = (tree or trained()).judge(table_of(blocks))
    return " ".join([b.text for b, k in zip(blocks, keep) if k])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if there is none), n_chars (its code points), from the whole html.

    Null html counts as empty. Repeated pages give repeated rows. The tree (a few dozen nodes) goes with
    the task.
    """
    tree = trained()
    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)

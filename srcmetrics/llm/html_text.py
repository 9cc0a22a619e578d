"""Main text of web pages: flat text blocks, classified by a decision tree on their own and
their neighbours' word counts and link densities and on the kind of element around them."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose begin and end part blocks; all others, line breaks too, are white space or
#: nothing within a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol"
    " option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED_TAGS = ("script", "style", "noscript", "template", "svg", "textarea", "iframe")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, and words of a class, id or role, that hold no article text. The words stand alone or
#: are the first or last part of a token (``site-footer``), unless another part denies them.
ASIDE_TAGS = frozenset("aside button dialog fieldset footer form head header label menu nav option select".split())
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement alert banner breadcrumb breadcrumbs comment comments complementary consent"
    " contentinfo cookie cookies disclaimer footer gdpr header masthead menu menubar modal nav navbar"
    " navigation newsletter notice popup promo promoted reply replies sidebar"
    " sponsor sponsored subscribe toolbar widget".split()
)
DENYING_WORDS = frozenset("has have no non not without with hide hidden is layout".split())
#: Words that tell as much only outside an article; within one the block itself decides.
DOUBTFUL_WORDS = frozenset("related search share sharing social".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())
MAIN_TAGS, MAIN_WORDS = frozenset({"article", "main"}), frozenset({"article", "main", "post", "entry"})
MAIN, NEUTRAL, ASIDE = 0, 1, 2
#: Inline elements that are looked at for such words; all else within a block is text.
INLINE_TAGS = frozenset("a abbr b em i ins mark q small span strong sub sup u".split())

#: The labelled blocks that the tree is trained on: words and link density of the block, the
#: one before and the one after, the zone, and whether the block is main text.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "zone")
LABELLED = (
    # in an article
    (11, 0.0, 7, 0.0, 60, 0.0, MAIN, 1),
    (9, 0.0, 1, 1.0, 45, 0.0, MAIN, 1),
    (2, 0.0, 50, 0.0, 40, 0.0, MAIN, 1),
    (1, 0.0, 30, 0.0, 3, 0.0, MAIN, 1),
    (4, 0.0, 8, 0.0, 9, 0.0, MAIN, 1),
    (80, 0.0, 12, 0.0, 70, 0.0, MAIN, 1),
    (120, 0.05, 90, 0.0, 10, 0.2, MAIN, 1),
    (35, 0.1, 12, 0.0, 12, 0.0, MAIN, 1),
    (60, 0.3, 44, 0.1, 51, 0.0, MAIN, 1),
    (25, 0.45, 40, 0.0, 33, 0.0, MAIN, 1),
    (6, 0.0, 120, 0.0, 11, 0.1, MAIN, 1),
    (14, 0.0, 60, 0.0, 0, 0.0, MAIN, 1),
    (5, 0.0, 7, 0.0, 5, 0.0, MAIN, 1),
    (5, 0.0, 5, 0.0, 12, 0.0, MAIN, 1),
    (12, 0.0, 3, 0.0, 2, 0.0, MAIN, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, MAIN, 1),
    (3, 0.0, 1, 1.0, 4, 0.0, MAIN, 1),
    (7, 0.0, 16, 0.1, 1, 0.0, MAIN, 1),
    (10, 0.0, 10, 0.0, 1, 1.0, MAIN, 1),
    (2, 0.0, 4, 0.0, 2, 0.5, MAIN, 1),
    (30, 0.0, 0, 0.0, 5, 0.3, MAIN, 1),
    (16, 0.2, 9, 0.1, 4, 0.0, MAIN, 1),
    (2, 0.0, 50, 0.0, 1, 1.0, MAIN, 1),
    (4, 0.0, 30, 0.0, 3, 1.0, MAIN, 1),
    (6, 0.0, 12, 0.0, 2, 0.9, MAIN, 1),
    (1, 0.0, 5, 0.0, 1, 1.0, MAIN, 1),
    (1, 1.0, 60, 0.0, 1, 1.0, MAIN, 0),
    (2, 1.0, 1, 1.0, 2, 1.0, MAIN, 0),
    (3, 1.0, 2, 1.0, 14, 0.0, MAIN, 0),
    (8, 0.9, 44, 0.0, 7, 0.9, MAIN, 0),
    # with nothing that tells around it
    (90, 0.0, 12, 0.0, 75, 0.0, NEUTRAL, 1),
    (60, 0.02, 80, 0.0, 4, 0.0, NEUTRAL, 1),
    (40, 0.1, 1, 1.0, 66, 0.0, NEUTRAL, 1),
    (28, 0.2, 3, 1.0, 35, 0.1, NEUTRAL, 1),
    (22, 0.0, 5, 0.0, 8, 0.3, NEUTRAL, 1),
    (130, 0.25, 2, 1.0, 6, 0.5, NEUTRAL, 1),
    (18, 0.0, 55, 0.0, 48, 0.0, NEUTRAL, 1),
    (7, 0.0, 62, 0.0, 58, 0.0, NEUTRAL, 1),
    (10, 0.0, 2, 1.0, 70, 0.0, NEUTRAL, 1),
    (5, 0.0, 30, 0.1, 33, 0.0, NEUTRAL, 1),
    (3, 0.0, 48, 0.0, 90, 0.0, NEUTRAL, 1),
    (45, 0.0, 38, 0.0, 0, 0.0, NEUTRAL, 1),
    (31, 0.0, 30, 0.0, 0, 0.0, NEUTRAL, 1),
    (6, 0.0, 1, 1.0, 3, 0.0, NEUTRAL, 0),
    (8, 0.1, 70, 0.0, 0, 0.0, NEUTRAL, 0),
    (9, 0.0, 2, 1.0, 5, 0.0, NEUTRAL, 0),
    (4, 0.0, 3, 0.5, 2, 1.0, NEUTRAL, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, NEUTRAL, 0),
    (3, 1.0, 2, 1.0, 80, 0.0, NEUTRAL, 0),
    (12, 0.8, 3, 1.0, 5, 1.0, NEUTRAL, 0),
    (40, 0.9, 10, 0.9, 12, 1.0, NEUTRAL, 0),
    (25, 0.7, 60, 0.0, 20, 0.7, NEUTRAL, 0),
    (2, 0.0, 4, 0.0, 1, 1.0, NEUTRAL, 0),
    (6, 0.5, 60, 0.0, 5, 0.6, NEUTRAL, 0),
    # in a menu, header, footer, sidebar, notice, advert, form or reader comment
    (1, 1.0, 0, 0.0, 1, 1.0, ASIDE, 0),
    (2, 1.0, 12, 0.0, 2, 1.0, ASIDE, 0),
    (7, 0.0, 1, 1.0, 11, 0.0, ASIDE, 0),
    (12, 0.0, 60, 0.0, 0, 0.0, ASIDE, 0),
    (14, 0.1, 70, 0.0, 3, 0.5, ASIDE, 0),
    (30, 0.0, 5, 0.0, 2, 0.0, ASIDE, 0),
    (45, 0.0, 40, 0.0, 38, 0.0, ASIDE, 0),
    (90, 0.0, 6, 0.0, 85, 0.0, ASIDE, 0),
    (4, 0.0, 90, 0.0, 20, 0.0, ASIDE, 0),
    (11, 0.0, 1, 1.0, 60, 0.0, ASIDE, 0),
)


@dataclass(frozen=True)
class Node:
    """A question (is the feature below the bound?) with two answers, or a leaf's share of
    main text."""

    share: float
    feature: int = -1
    bound: float = 0.0
    below: Node | None = None
    above: Node | None = None


def train_tree(rows: tuple[tuple[float, ...], ...] = LABELLED, depth: int = 7) -> Node:
    """The decision tree with the least Gini impurity at each question."""
    table = np.array(rows, float)
    return _grow(table[:, :-1], table[:, -1], depth)


def _impurity(y: np.ndarray) -> float:
    return len(y) * 2 * y.mean() * (1 - y.mean()) if len(y) else 0.0


def _grow(x: np.ndarray, y: np.ndarray, depth: int) -> Node:
    best = (_impurity(y) - 1e-9, -1, 0.0)
    if depth and best[0] > 0:
        for feature in range(x.shape[1]):
            values = np.unique(x[:, feature])
            for bound in (values[1:] + values[:-1]) / 2:
                below = x[:, feature] < bound
                best = min(best, (_impurity(y[below]) + _impurity(y[~below]), feature, float(bound)))
    if best[1] < 0:
        return Node(float(y.mean()))
    below = x[:, best[1]] < best[2]
    return Node(
        float(y.mean()), best[1], best[2], _grow(x[below], y[below], depth - 1), _grow(x[~below], y[~below], depth - 1)
    )


def classify(tree: Node, x: np.ndarray) -> np.ndarray:
    """Whether each row of features is main text."""
    if tree.below is None or tree.above is None:
        return np.full(len(x), tree.share >= 0.5)
    below = x[:, tree.feature] < tree.bound
    out = np.empty(len(x), bool)
    out[below] = classify(tree.below, x[below])
    out[~below] = classify(tree.above, x[~below])
    return out


_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<skip>{'|'.join(SKIPPED_TAGS)})\b.*?(?:</(?P=skip)\b[^>]*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z)"""
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_PART = re.compile(r"[a-z]+")
#: How an element changes the zone: by itself, unless an article within it wins; only outside an
#: article; as main text.
_HARD, _SOFT, _DOUBT, _MAIN = range(4)


def _names(rest: str) -> list[list[str]]:
    """The parts of each token of an element's class, id and role."""
    found = (m[1] or m[2] or m[3] or "" for m in _NAMED.finditer(rest)) if rest else ()
    return [parts for names in found for token in names.lower().split() if (parts := _NAME_PART.findall(token))]


def _told(tokens: list[list[str]], words: frozenset[str]) -> bool:
    return any((t[0] in words or t[-1] in words) and DENYING_WORDS.isdisjoint(t) for t in tokens)


def _kind(tag: str, rest: str) -> int | None:
    """What an element says of the blocks within it."""
    tokens = _names(rest)
    if tag in MAIN_TAGS:
        return _HARD if _told(tokens, COMMENT_WORDS) else _MAIN
    if tag in ASIDE_TAGS:
        return _SOFT if tag in ("form", "fieldset") else _HARD
    if tag in ("html", "body"):
        return None
    if _told(tokens, ASIDE_WORDS):
        return _HARD if _told(tokens, COMMENT_WORDS) else _SOFT
    if _told(tokens, DOUBTFUL_WORDS):
        return _DOUBT
    return _MAIN if any(not MAIN_WORDS.isdisjoint(t) for t in tokens) else None


class _Open:
    """The open block elements. Places of each tag and kind are kept, so that a mark costs no
    more in a deep page than in a flat one."""

    def __init__(self):
        self._stack: list[tuple[str, int | None]] = []
        self._of_tag: dict[str, list[int]] = {}
        self._of_kind: list[list[int]] = [[], [], [], []]
        self._articles: list[int] = []

    def __len__(self) -> int:
        return len(self._stack)

    @property
    def last(self) -> str:
        return self._stack[-1][0] if self._stack else ""

    def push(self, tag: str, kind: int | None) -> None:
        at = len(self._stack)
        self._stack.append((tag, kind))
        self._of_tag.setdefault(tag, []).append(at)
        if kind is not None:
            self._of_kind[kind].append(at)
        if kind == _MAIN and tag in MAIN_TAGS:
            self._articles.append(at)

    def pop(self) -> None:
        tag, kind = self._stack.pop()
        self._of_tag[tag].pop()
        if kind is not None:
            self._of_kind[kind].pop()
        if kind == _MAIN and tag in MAIN_TAGS:
            self._articles.pop()

    def end(self, tag: str) -> None:
        """Closes the innermost element of that name, if there is one, and what is in it."""
        if self._of_tag.get(tag):
            for _ in range(len(self._stack) - self._of_tag[tag][-1]):
                self.pop()

    def zone(self) -> int:
        hard, soft, doubt, main = self._of_kind
        article = self._articles[-1] if self._articles else -1
        if hard:
            # an article's own header belongs to it
            own = len(hard) == 1 and self._stack[hard[0]][0] == "header" and main and hard[0] > main[0]
            return MAIN if own and not (soft and soft[-1] > article) else ASIDE
        if soft and soft[-1] > article:
            return ASIDE
        if doubt and doubt[-1] > article:
            return NEUTRAL if main else ASIDE
        return MAIN if main else NEUTRAL


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """The flat text blocks of a page in order, and their features.

    Begin and end tags of block elements part the text. Within a block character references
    are decoded and white space is one space; scripts, styles, comments and inline adverts and
    the like are left out. A page may be cut off or leave elements open: an end tag closes the
    innermost element of its name, if there is one, and what is open within it; a link ends
    with the block element around it."""
    texts: list[str] = []
    words: list[int] = []
    links: list[float] = []
    zones: list[int] = []
    opened = _Open()
    zone, linked, parts = NEUTRAL, 0, []
    link_depth: int | None = None
    # an inline element that is left out: its name, how often that is open in it, its depth
    hidden, hidden_open, hidden_depth = "", 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = text.count(" ") + 1
            texts.append(text)
            words.append(n)
            links.append(min(1.0, linked / n))
            zones.append(zone)
        parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            parts.append(text)
            if link_depth is not None:
                linked += len(text.split())

    at = 0
    for mark in _MARKUP.finditer(page):
        take(page[at : mark.start()])
        at = mark.end()
        tag = (mark["tag"] or "").lower()
        if not tag:
            continue
        ends, rest = bool(mark["end"]), mark["rest"] or ""
        if tag == hidden:
            hidden_open += -1 if ends else 1
            if not hidden_open:
                hidden = ""
                parts.append(" ")
        elif tag in INLINE_TAGS and not hidden and not ends and _told(_names(rest), ASIDE_WORDS):
            hidden, hidden_open, hidden_depth = tag, 1, len(opened)
        if tag == "a":
            link_depth = None if ends else len(opened)
        elif tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS or tag not in BLOCK_TAGS:
            continue
        close()
        if not ends:
            if tag in ("p", "li") and opened.last == tag:
                opened.pop()
            if not rest.endswith("/"):
                opened.push(tag, _kind(tag, rest))
        else:
            opened.end(tag)
        if link_depth is not None and len(opened) < link_depth:
            link_depth = None
        if hidden and len(opened) < hidden_depth:
            hidden = ""
        zone = opened.zone()
    take(page[at:])
    close()
    w, d = np.array(words, float), np.array(links, float)
    before, after = slice(0, len(w)), slice(2, None)
    wide, dense = np.pad(w, 1), np.pad(d, 1)
    features = np.column_stack((w, d, wide[before], dense[before], wide[after], dense[after], np.array(zones, float)))
    return texts, features


def main_text(page: str | None, tree: Node) -> str:
    """The blocks of a page that the tree takes for main text, joined by an empty line. A page of
    short blocks alone, of which it takes none, has those that are no links and lie in nothing
    that tells otherwise."""
    texts, features = blocks(page or "")
    if not texts:
        return ""
    main = classify(tree, features)
    if not main.any():
        main = (features[:, 6] == NEUTRAL) & (features[:, 1] < 0.5)
    return "\n\n".join(t for t, chosen in zip(texts, main, strict=True) if chosen)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)`` from its
    whole html. A null or empty html, and a page without main text, has the empty text;
    repeated rows stay; an empty table gives no rows."""
    tree = train_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page, tree) for page in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])

    found = pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))

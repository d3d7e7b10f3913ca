"""Main text of HTML pages by tag-path ratios.

Every piece of text has a path of tags from the root (inline mark-up left out). Text lengths and punctuation marks are
added up by path and divided by the number of pieces on it; the two ratios are fused, smoothed along the page and
averaged by path again. What a path's elements are is a factor of its score: 0 below elements that the standard gives to
menus, forms and the like, little below those that a whole class name, id or role calls so, and little outside the
`article` (else `main`) element that holds most of the text. Paths whose score is at least a share of the scores'
deviation hold content, and content selects containers (the article element, else what is around the content): their
short blocks stay too, as do the title before them and all between them, unless a factor holds them down.

Names of inline elements and headings don't count, nor do those of paragraphs with content, of parts that hold most of
the content, and of headers inside the article; where everything is named, names don't count either.

A page is read whole by whichever task has its row, in time that is linear in its length; nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

SHARE = 0.3  # of the scores' deviation, from which a path holds content
MOST = 0.5  # of the content, from which a part named as layout is the article's all the same
NAMED_PART, FOREIGN_PART, OUTSIDE, LINKED = 0.02, 0.002, 0.005, 0.2  # factors of a path's score
FLOOR = 0.004  # on pages with an article element, factors below this are 0

# Fixed values of the HTML standard: elements without an end, without text of the page, inside lines, closing a `p`.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|svg|title|noframes|xmp|object|math"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
NOT_ARTICLE = frozenset("head nav footer aside form button select dialog menu fieldset search".split())
#: What the class, id or role of a part that is not the article's text may be called.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidenav aside nav navbar navigation menu breadcrumb breadcrumbs header masthead footer contentinfo complementary comment comments commentlist respond disqus reply replies share sharing social related recommended newsletter subscribe subscription signup login search form widget toolbar pagination pager skip".split())
#: Of these, what stays out however much it holds: it is not the article's even where it is longer.
FOREIGN = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr nav navbar navigation menu breadcrumb breadcrumbs footer contentinfo comment comments commentlist respond disqus reply replies related recommended newsletter subscribe subscription".split())
#: Words that may stand beside NAMES in a name that calls the whole part so; others make it a different name.
BESIDE = frozenset("area article articles bar block body bottom box button buttons container content desktop entry global icons inline inner item items left link links list main mobile outer page post posts primary right row secondary section site story title top wrap wrapper".split())
#: Those that make a header one of the article.
OWN = frozenset("article content entry page post section story title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements within a text, which the container around them holds.
PARTS = INLINE | HEADINGS | frozenset("p ul ol li dl dt dd table caption colgroup thead tbody tfoot tr td th blockquote pre figure figcaption address details summary header".split())
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
MARK = re.compile(r"[.,;:!?…。，、！？؛،]")


class _Element:
    """An open or closed element; what it says of its text is settled when it opens, so that no path is walked again."""

    __slots__ = ("article", "at", "block", "container", "h1", "header", "heading", "holds", "linked", "main", "named", "out", "parent", "path", "tag")

    def __init__(self, at: int, tag: str, parent: _Element | None, path: int):
        self.at, self.tag, self.parent, self.path = at, tag, parent, path
        self.out = self.holds = False  # by its own tag; whether it holds an article, a main part or the whole page
        self.named: frozenset[str] = frozenset()
        self.block = parent.block if parent and tag in INLINE else self
        self.container = parent.container if parent and tag in PARTS else self
        # the outermost ones around it, which hold at least as much as those within them
        self.article = parent and parent.article or (self if tag == "article" else None)
        self.main = parent and parent.main or (self if tag == "main" else None)
        self.linked = tag == "a" or bool(parent and parent.linked)
        self.heading = tag in HEADINGS or bool(parent and parent.heading)
        self.h1 = tag == "h1" or bool(parent and parent.h1)
        self.header = parent.header if parent else None  # the outermost header around it that is no article's


def _called(names: set[str]) -> set[str]:
    """Which of NAMES the whole names call a part."""
    found = set()
    for name in names:
        of = set(re.split(r"[^a-z0-9]+", name)) - {""}
        if of <= NAMES | BESIDE:
            found |= of & NAMES - ({"header"} if of & OWN else set())
    return found


class _Page:
    """Elements in the order in which they open, and pieces of text: their element, the number of their block, the text."""

    def __init__(self, page: str):
        self.elements = [_Element(0, "", None, 0)]
        self.pieces: list[tuple[_Element, int, str]] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._stack, self._open = [self.elements[0]], defaultdict(list)
        self._read(page)

    def _close(self, k: int) -> None:
        for e in reversed(self._stack[k:]):
            self._open[e.tag].pop()
        del self._stack[k:]

    def _last(self, tags: Iterator[str]) -> int:
        return max((self._open[t][-1] for t in tags if self._open[t]), default=0)

    def _make_room(self, tag: str) -> None:
        """Ends the elements that a block or part of a list or table ends by opening."""
        if tag in CLOSES:
            ends, within = CLOSES[tag]
            barrier = self._last(within)
            while (k := self._last({*ends.split(), "p"})) > barrier:
                self._close(k)
        elif self._stack[-1].block.tag == "p":
            self._close(self._open["p"][-1])

    def _begin(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._make_room(tag)
        above = self._stack[-1]
        whole = {w for x in NAMED.finditer(attributes) for w in next(g for g in x.groups() if g is not None).lower().split()} if attributes else set()
        names = {w for name in whole for w in re.split(r"[^a-z0-9]+", name)} - {""}
        label = "" if tag in INLINE and tag != "a" else tag if tag == "a" else tag + "".join(sorted("." + n for n in names))
        path = self._paths.setdefault((above.path, label), len(self._paths) + 1) if label else above.path
        here = _Element(len(self.elements), tag, above, path)
        own = bool(above.article or above.main) and (tag == "header" or "header" in names)  # a header inside the article
        called = _called(whole) if whole and tag not in INLINE and tag not in HEADINGS else set()
        here.out = tag in NOT_ARTICLE
        here.named = frozenset(called - {"header"} if own else called)
        if not own and (tag == "header" or here.named == {"header"}) and above.header is None:
            here.header = here
            here.named = frozenset()
        if tag in ("article", "main", "body", "html"):
            e = here
            while e is not None and not e.holds:
                e.holds, e = True, e.parent
        self.elements.append(here)
        self._open[tag].append(len(self._stack))
        self._stack.append(here)

    def _read(self, page: str) -> None:
        block = 0
        for m in TOKEN.finditer(page):
            token = m.group()
            if m.group(1):
                continue
            end, tag, attributes = m.group(2, 3, 4) if m.group(3) else m.group(5, 6, 7)  # the latter with a quote left open
            if tag is None:
                if token[0] != "<" or token == "<":
                    self.pieces.append((self._stack[-1], block, entities.unescape(token) if "&" in token else token))
                continue
            tag = tag.lower()
            if tag == "br":
                self.pieces.append((self._stack[-1], block, " "))
                continue
            block += tag not in INLINE
            if end:
                if self._open[tag]:
                    self._close(self._open[tag][-1])
            elif tag not in VOID:
                self._begin(tag, attributes)


def ratios(path: np.ndarray, length: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Each piece's score by its path: text and punctuation per piece of the path, fused, smoothed along the page and
    averaged by path."""
    _, path = np.unique(path, return_inverse=True)
    n = path.max() + 1
    nodes = np.maximum(1, np.bincount(path, length > 0, n))
    ratio = np.bincount(path, length, n) / nodes * (1 + np.bincount(path, marks, n) / nodes)
    line = ratio[path]
    smooth = np.convolve(np.pad(line, 1, mode="edge"), [0.25, 0.5, 0.25], "valid")
    return np.sqrt(np.bincount(path, smooth * line, n) / np.bincount(path, minlength=n))[path]


def _content(score: np.ndarray) -> np.ndarray:
    return (score > 0) & (score >= SHARE * score.std())


def _factors(page: _Page, mass: np.ndarray) -> np.ndarray:
    """What each element's tags and names leave of its text's score; `mass` is each element's text with content."""
    elements = page.elements
    barred = np.zeros(len(elements), bool)
    for e in elements[1:]:
        barred[e.at] = barred[e.parent.at] or e.out or e.header is not None
    mass = np.where(barred, 0.0, mass)
    for e in reversed(elements[1:]):  # parents open before their children
        mass[e.parent.at] += mass[e.at]
    factor = np.ones(len(elements))
    for e in elements[1:]:
        own = 0.0 if e.out else 1.0
        if e.named and not e.holds:
            of_article = mass[e.at] > (0 if e.tag == "p" else MOST * mass[0]) and not e.named & FOREIGN
            own *= 1.0 if of_article else FOREIGN_PART if e.named & FOREIGN else NAMED_PART
        factor[e.at] = factor[e.parent.at] * own
    return factor


def _home(page: _Page, weight: np.ndarray) -> _Element | None:
    """The article (else main) element whose text weighs most; or an empty one. None if there is no such element."""
    held: dict[_Element, float] = {e: 0.0 for e in page.elements if e in (e.article, e.main)}
    for (e, _, _), w in zip(page.pieces, weight, strict=True):
        for part in {e.article, e.main} - {None}:
            held[part] += w
    some = [e for e in held if e.tag == "article" and held[e] > 0] or [e for e in held if e.tag == "main" and held[e] > 0] or list(held)
    return max(some, key=held.get, default=None)


def _in(home: _Element | None, e: _Element) -> bool:
    return home is not None and home in (e.article, e.main)


def main_blocks(page: str | None) -> list[str]:
    """The article's blocks in page order, white space made single."""
    read = _Page(page or "")
    pieces = read.pieces = [p for p in read.pieces if p[2]]
    if not pieces:
        return []
    length = np.array([len(text.strip()) for _, _, text in pieces], float)
    marks = np.array([len(MARK.findall(text)) for _, _, text in pieces], float)
    at = np.array([e.at for e, _, _ in pieces])
    raw = ratios(np.array([e.path for e, _, _ in pieces]), length, marks)
    mass = np.bincount(at, np.where(_content(raw), length, 0), len(read.elements))
    layout = _factors(read, mass)[at]
    home = _home(read, np.where(_content(raw), length, 0) * layout)
    if home:
        layout *= [1.0 if _in(home, e) else OUTSIDE for e, _, _ in pieces]
        layout[layout < FLOOR] = 0
    headed = np.array([e.header is not None for e, _, _ in pieces])
    linked = np.array([e.linked for e, _, _ in pieces])
    score = np.where(headed, 0, raw * layout * np.where(linked, LINKED, 1))
    full = length > 0
    content = np.flatnonzero(_content(score) & full)
    if not len(content):
        content = np.flatnonzero(full & ~headed & (layout > 0))
    if not len(content):
        return []
    blocks: dict[int, list[str]] = defaultdict(list)
    for k in _around(read, content.tolist(), layout, linked, home):
        blocks[pieces[k][1]].append(pieces[k][2])
    texts = (" ".join("".join(blocks[b]).split()) for b in sorted(blocks))
    return [t for t in texts if t]


def _around(page: _Page, content: list[int], layout: np.ndarray, linked: np.ndarray, home: _Element | None) -> list[int]:
    """The pieces of the article: content, and short blocks and titles that belong to it."""
    pieces, chosen = page.pieces, set(content)
    container = lambda e: home if _in(home, e) else e.container
    containers = {container(pieces[k][0]) for k in content}
    own = lambda e: e.header is None or (e.header.parent in containers and e.header.parent.tag not in ("", "html", "body"))
    least = 0.5 * max(layout[k] for k in content)
    inside = [k for k, (e, _, _) in enumerate(pieces) if k in chosen or (layout[k] >= least and own(e))]
    unlinked = {pieces[k][1] for k in inside if not linked[k] and pieces[k][2].strip()}
    first, last = content[0], content[-1]
    top, start = set(), first
    if not home:  # the title stands before the content: an h1, else headings right before it
        before = [k for k in inside if k < first and pieces[k][2].strip()]
        top = {k for k in before if pieces[k][0].h1}
        start = max(top, default=first)
        while not top and before and pieces[before[-1]][0].heading:
            start = before.pop()

    def belongs(k: int) -> bool:
        e, block, _ = pieces[k]
        if _in(home, e):
            return True
        return (e.heading or block in unlinked) and (start <= k < first or container(e) in containers)

    return [k for k in inside if first <= k <= last or k in top or belongs(k)]


def extract_text(pages: DataFrame, html: str = "html", column: str = "text") -> DataFrame:
    """`pages` less `html`, with the main text in `column`: blocks joined by two line ends, empty if there are none.

    Null html counts as empty. Truncated pages, unclosed elements and raw text in scripts are read as browsers do. A
    column of the input named as `column` is replaced; repeated rows are extracted each.
    """
    names = [c for c in pages.columns if c not in (html, column)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n\n".join(main_blocks(x.as_py())) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*names, column])

    return pages.select(*names, html).mapInArrow(run, pages.select(*names).withColumn(column, F.lit("")).schema)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

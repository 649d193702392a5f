"""HTML extraction by wrapper induction: DOM trees of same-host pages aligned by simple tree matching."""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import bounded, small, stage

#: Shapes of subtrees and alignments that a reference page's matcher keeps, and reference pages that a task keeps.
SHAPES, REFERENCES = 1 << 14, 64
#: Elements that make up a layout, and how deep in body they count.
FRAME, DEEP = set("article div main section table tbody td tr".split()), 2
#: Cells of an alignment's table that are held at a time.
CELLS = 1 << 20
#: Elements that are open at a time, as browsers bound them too: what is nested deeper puts its text where it stands.
DEPTH = 256
#: Trees of that depth are walked by recursion, a few calls a level.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))
#: A node is template if it holds the same text in this part of the aligned pages.
CONSTANT = 0.6
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROP = set("head title script style noscript template nav header footer aside button select option textarea iframe object svg canvas video audio dialog menu".split())
#: A form is left out unless it holds this many characters of text for each of its inputs (one at least), or most of the page's text.
FORM_TEXT = 80
INPUTS = set("input select textarea button".split())
#: Elements whose start ends an open element of the second kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
def _words(names: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{names})(?=$|[\s_-])", re.I)


#: Words of class and id that hint at adverts, notices and the like; an element that holds most of the page's text is none of these.
BOILER = _words(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav\w*|footer|header|masthead|cookie\w*|consent|notice|alert|share|sharing|social|related|recommend\w*|breadcrumbs?|popup|modal|newsletter|subscribe|login|signup|widget|toolbar|pagination|pager|copyright|teaser")
#: Of readers' comments, which may well be longer than the article.
READERS = _words(r"comments?|disqus|respond|replies|reviews")
#: Elements whose class and id say nothing against their text.
PLAIN = set("html body article main h1 h2 h3 h4 h5 h6".split())
#: Paths within the elements that name the content.
CONTENT = re.compile(r"/(?:article|main)(?=[./]|$)")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}


@dataclass
class Node:
    tag: str
    sign: str
    drop: bool = False
    #: text pieces and child nodes in page order
    parts: list = field(default_factory=list)
    #: its class or id hints that it isn't content: 1 for adverts and the like, 2 for readers' comments
    hint: int = 0
    #: of a form: the inputs in it that are seen
    inputs: int = 0

    @property
    def children(self) -> list[Node]:
        return [x for x in self.parts if isinstance(x, Node)]

    def text(self) -> str:
        return " ".join("".join(x for x in self.parts if isinstance(x, str)).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", "")
        self.open = [self.root]
        self.dropped = 0  # open elements that are left out
        self.flat: Counter[str] = Counter()  # ends to come of elements that were not opened
        self.forms: list[Node] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("br", "hr"):
            self.open[-1].parts.append("\n")
        values = {k: v or "" for k, v in attrs}
        if tag in INPUTS and self.forms and values.get("type", "").lower() != "hidden":
            self.forms[-1].inputs += 1
        if tag in VOID:
            return
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or values.get("role") in ROLES
        names = [values[k] for k in ("class", "id") if values.get(k)]
        readers, boiler = (any(map(p.search, names)) for p in (READERS, BOILER)) if names else (False, False)
        named = (readers or boiler) and tag not in PLAIN
        if tag in INLINE and not (hidden or named):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            over = self.open[depth].tag
            if over in CLOSES.get(tag, ()) or over == "p" and tag not in INLINE:
                self.end(depth)
                break
            if over in ("ul", "ol", "dl", "table", "div", "article", "section", "main", "body"):
                break
        drop = tag in DROP or hidden
        if len(self.open) >= DEPTH and (self.dropped or not drop or len(self.open) >= 2 * DEPTH):
            self.open[-1].parts.append("\n")
            self.flat[tag] += 1
            return
        node = Node(tag, tag + ("." + values["class"].split()[0].replace("/", "|") if values.get("class", "").split() else ""), drop, hint=0 if tag in ("html", "body") else 2 if readers and named else int(boiler))
        if tag == "form":
            self.forms.append(node)
        self.open[-1].parts.append(node)
        self.open.append(node)
        self.dropped += drop

    def end(self, depth: int) -> None:
        self.dropped -= sum(n.drop for n in self.open[depth:])
        self.forms = [f for f in self.forms if not any(f is n for n in self.open[depth:])] if self.forms else []
        del self.open[depth:]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs) if tag in VOID else None
        else:
            self.handle_starttag(tag, attrs)  # in HTML the slash has no meaning

    def handle_endtag(self, tag: str) -> None:
        if self.flat[tag]:
            self.flat[tag] -= 1
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self.end(depth)
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines aren't counted


def _weigh(n: Node, sizes: dict[int, int]) -> int:
    """Characters of text in and below a node that isn't left out, without white space; readers' comments only count as their own."""
    sizes[id(n)] = 0 if n.drop else sum(len("".join(p.split())) if isinstance(p, str) else _weigh(p, sizes) for p in n.parts)
    return 0 if n.hint == 2 else sizes[id(n)]


def _judge_hints(n: Node, sizes: dict[int, int], whole: int) -> tuple[int, list[Node]]:
    """Leaves out forms and what hints speak against. Returns the text that stays outside of headings, and the nodes that hints took.
    An article of which hints would leave less than a tenth of what they take keeps it: they can't mean its own text."""
    rest, taken = 0, []
    for c in n.parts:
        if isinstance(c, str):
            rest += len("".join(c.split()))
        elif not c.drop:
            size = sizes[id(c)]
            if c.tag == "form":
                c.drop = size < FORM_TEXT * max(1, c.inputs) and 2 * size <= whole
            if c.tag not in PLAIN and c.hint and (c.hint == 2 or 2 * size <= whole):
                c.drop = True
                taken.append(c)
            own, more = _judge_hints(c, sizes, whole)
            if c.tag in ("article", "main") and more and 10 * own < sum(sizes[id(x)] for x in more):
                for x in more:
                    x.drop = False
                own, more = sizes[id(c)], []
            if not c.drop:
                rest += 0 if c.tag in HEADINGS else own
                taken += more
    return rest, taken


HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_OPAQUE = re.compile(r"<!--|<(script|style)(?=[\s/>])", re.I)
_ENDS = {"": re.compile(r"--!?>"), "script": re.compile(r"</script(?=[\s/>])[^>]*>?", re.I), "style": re.compile(r"</style(?=[\s/>])[^>]*>?", re.I)}


def scrub(html: str | None) -> str:
    """The page without comments, scripts and styles, in one pass; what isn't closed goes to the page's end, as browsers have it."""
    html, out, at = html or "", [], 0
    while m := _OPAQUE.search(html, at):
        out.append(html[at : m.start()])
        if html.startswith(("<!-->", "<!--->"), m.start()):
            at = html.index(">", m.start()) + 1
            continue
        end = _ENDS[(m[1] or "").lower()].search(html, m.end())
        if not end:
            at = len(html)
            break
        at = end.end()
    out.append(html[at:])
    clean = "".join(out)
    last = clean.rfind(">") + 1
    tail = _TAG_START.search(clean, last)  # a tag that the page's end cuts off is none
    return clean[: tail.start()] if tail else clean


_TAG_START = re.compile(r"<[A-Za-z/!?]")


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(scrub(html))
    builder.close()
    sizes: dict[int, int] = {}
    _judge_hints(builder.root, sizes, _weigh(builder.root, sizes))
    return builder.root


class _Matcher:
    """Simple tree matching over trees of any size: equal shapes are one, and the matching of two shapes is worked out once."""

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.kids: list[tuple[int, ...]] = []
        self.signs: list[str] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}
        self.aligned: dict[tuple[tuple, tuple], list[tuple[int, int]]] = {}

    def shape(self, n: Node, of: dict[int, int]) -> int:
        own = tuple(self.shape(c, of) for c in n.children)
        at = self.shapes.setdefault((n.sign, own), len(self.kids))
        if at == len(self.kids):
            self.kids.append(own)
            self.signs.append(n.sign)
            self.sizes.append(1 + sum(self.sizes[c] for c in own))
        of[id(n)] = at
        return at

    def size(self, a: int, b: int) -> int:
        if a == b:
            return self.sizes[a]
        if self.signs[a] != self.signs[b]:
            return 0
        if (a, b) not in self.known:
            x, y = self.kids[a], self.kids[b]
            head, x, y, tail = self.ends(x, y)
            self.known[a, b] = 1 + head + tail + (int(self.last_row(x, y)[-1]) if x and y else 0)
        return self.known[a, b]

    def ends(self, x: tuple, y: tuple) -> tuple[int, tuple, tuple, int]:
        """Equal shapes at both ends are matched by a largest matching."""
        i, j = 0, 0
        while i < min(len(x), len(y)) and x[i] == y[i]:
            i += 1
        while j < min(len(x), len(y)) - i and x[-1 - j] == y[-1 - j]:
            j += 1
        return sum(self.sizes[c] for c in x[:i]), x[i : len(x) - j], y[i : len(y) - j], sum(self.sizes[c] for c in x[len(x) - j :])

    def rows(self, x: tuple, y: tuple) -> Iterator[np.ndarray]:
        """The alignment's table, row by row."""
        other, of = np.unique(np.array(y), return_inverse=True)
        now, made = np.zeros(len(y) + 1, np.int64), {}
        yield now
        for c in x:
            if c not in made:
                made[c] = np.array([self.size(c, int(d)) for d in other])[of]
            new = now.copy()
            np.maximum(now[1:], now[:-1] + made[c], out=new[1:])
            now = np.maximum.accumulate(new)
            yield now

    def last_row(self, x: tuple, y: tuple) -> np.ndarray:
        for row in self.rows(x, y):
            pass
        return row

    def align(self, x: tuple, y: tuple) -> list[tuple[int, int]]:
        """Places of a largest matching of two lists of shapes; large tables are halved (Hirschberg 1975)."""
        if not x or not y:
            return []
        _, core_x, core_y, _ = self.ends(x, y)
        if len(core_x) < len(x):
            i = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            back = len(x) - i - len(core_x)
            inner = [(i + p, i + q) for p, q in self.align(core_x, core_y)]
            return [(k, k) for k in range(i)] + inner + [(len(x) - k, len(y) - k) for k in range(back, 0, -1)]
        if len(x) > 1 and len(x) * len(y) > CELLS:
            half = len(x) // 2
            both = self.last_row(x[:half], y) + self.last_row(x[half:][::-1], y[::-1])[::-1]
            cut = int(both.argmax())
            return self.align(x[:half], y[:cut]) + [(half + p, cut + q) for p, q in self.align(x[half:], y[cut:])]
        m = list(self.rows(x, y))
        out, i, j = [], len(x), len(y)
        while i and j:
            if (w := self.size(x[i - 1], y[j - 1])) and m[i][j] == m[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif m[i][j] == m[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]

    def pairs(self, a: Node, b: Node, of: dict[int, int], out: list) -> None:
        out.append((a, b))
        x, y = a.children, b.children
        key = tuple(of[id(c)] for c in x), tuple(of[id(c)] for c in y)
        places = self.aligned.get(key)
        if places is None:
            places = self.align(*key)
            if len(x) + len(y) < 64:
                self.aligned[key] = places
        for i, j in places:
            self.pairs(x[i], y[j], of, out)


def simple_tree_matching(a: Node, b: Node, pairs: list | None = None) -> int:
    """Size of the largest order-keeping top-down matching of two trees (Yang 1991); pairs gets the matched nodes."""
    matcher, of = _Matcher(), {}
    size = matcher.size(matcher.shape(a, of), matcher.shape(b, of))
    if size and pairs is not None:
        matcher.pairs(a, b, of, pairs)
    return size


def _kept(node: Node) -> Node:
    return Node(node.tag, node.sign, node.drop, parts=[p if isinstance(p, str) else _kept(p) for p in node.parts if isinstance(p, str) or not p.drop])


_FRAMED = FRAME | DROP - VOID
_TAGS = re.compile(rf"<(/?)({'|'.join(sorted(_FRAMED - {'script', 'style'}))})(?=[\s/>])([^>]*)>", re.I | re.S)
_NAMES = re.compile(r"""\b(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


def layout(html: str | None) -> int:
    """A hash of the page's frame: the different paths of its outer container elements, at most DEEP deep in body, outside of
    those that are left out. It only tells which pages to align, so it is read off the tags without building the tree."""
    found: set[str] = set()
    #: open elements: tag, path, depth (over DEEP: nothing within counts)
    stack: list[tuple[str, str, int]] = [("", "", 0)]
    for m in _TAGS.finditer(scrub(html)):
        tag = m[2].lower()
        if m[1]:
            for at in range(len(stack) - 1, max(0, len(stack) - DEPTH), -1):
                if stack[at][0] == tag:
                    del stack[at:]
                    break
            continue
        _, path, depth = stack[-1]
        if depth >= DEEP or tag in DROP:
            stack.append((tag, path, DEEP))
            continue
        names = {k.lower(): a or b or c for k, a, b, c in _NAMES.findall(m[3])}
        if tag not in PLAIN and any(p.search(x) for p in (READERS, BOILER) for x in names.values()):
            stack.append((tag, path, DEEP))
            continue
        own = f"{path}/{tag}" + (f".{names['class'].split()[0]}" if names.get("class", "").split() else "")
        found.add(own)
        stack.append((tag, own, DEEP if tag in ("article", "main") else depth + 1))
    return int.from_bytes(hashlib.blake2b("\0".join(sorted(found)).encode(), digest_size=8).digest(), "big", signed=True)


_DIGITS = re.compile(r"\d+")


def _mark(path: str, text: str) -> str:
    return hashlib.blake2b(f"{path}\0{text}".encode(), digest_size=8).hexdigest()


class Reference:
    """The first page of a layout, which every other one is aligned with: its nodes in page order, with their paths and texts."""

    def __init__(self, html: str | None) -> None:
        self.tree = _kept(parse(html))
        self.at: dict[int, int] = {}
        self.paths: list[str] = []
        self.texts: list[str] = []
        for n, path in _walk(self.tree):
            self.at[id(n)] = len(self.paths)
            self.paths.append(path)
            self.texts.append(n.text())
        self.zeros = [_DIGITS.sub("0", t) for t in self.texts]
        self.exact = set(zip(self.paths, self.texts, strict=True))
        self.counted: dict[tuple[str, str], int] = {}
        for i, key in enumerate(zip(self.paths, self.zeros, strict=True)):
            self.counted.setdefault(key, i)
        self.renew()

    def renew(self) -> None:
        self.matcher, self.of = _Matcher(), {}
        self.top = self.matcher.shape(self.tree, self.of)

    def compare(self, html: str | None) -> tuple[list[int], str | None]:
        """What another page shows: 3 i for each node i that holds the same text there, 3 i + 1 for one that differs in digits at
        most, 3 i + 2 if such a text stands elsewhere at its path; and the path, ended by "/", that the parents of all texts lie in
        of which the reference has none alike at the same path (None: there is no such text)."""
        if len(self.matcher.kids) + len(self.matcher.aligned) > SHAPES:
            self.renew()
        tree, of, pairs = _kept(parse(html)), dict(self.of), []
        if self.matcher.size(self.top, self.matcher.shape(tree, of)):
            self.matcher.pairs(self.tree, tree, of, pairs)
        hits: list[int] = []
        for x, y in pairs:
            i = self.at[id(x)]
            if self.texts[i]:
                t = y.text()
                if t == self.texts[i]:
                    hits += [3 * i, 3 * i + 1]
                elif _DIGITS.sub("0", t) == self.zeros[i]:
                    hits.append(3 * i + 1)
        other, low, high = set(), None, None
        for n, path in _walk(tree):
            if (t := n.text()) and (path, t) not in self.exact:
                if (i := self.counted.get((path, _DIGITS.sub("0", t)))) is not None:
                    other.add(3 * i + 2)
                else:
                    above = path.rpartition("/")[0] + "/"
                    low, high = min(low or above, above), max(high or above, above)
        return hits + sorted(other), None if low is None else _within(low, high)

    def wrapper(self, counts: dict[int, int], others: int, vary: str | None) -> tuple[list[str], str]:
        """Marks of template nodes and the content slot, by how many of the `others` gave each number of compare()."""
        least = CONSTANT * others
        # the tag speaks for content: there, a text has to stand in three pages to be template, so that a pair of copies is not
        constant = {i for i in range(len(self.paths)) if counts.get(3 * i, 0) >= (max(least, 2) if CONTENT.search(self.paths[i]) else least)}
        marks = {(self.paths[i], self.texts[i]) for i in constant}
        counters = {(self.paths[i], self.zeros[i]) for i in range(len(self.paths)) if counts.get(3 * i + 1, 0) >= least and _DIGITS.search(self.texts[i])}
        for i, (path, t, zero) in enumerate(zip(self.paths, self.texts, self.zeros, strict=True)):
            if (path, zero) not in counters and (counts.get(3 * i + 2) or t and (path, t) not in marks):
                above = path.rpartition("/")[0] + "/"
                vary = above if vary is None else _within(min(vary, above), max(vary, above))
        return sorted(_mark(*m) for m in marks), "" if vary is None else vary[:-1] or "/"


def _walk(tree: Node) -> Iterator[tuple[Node, str]]:
    """Nodes in page order, with their paths."""
    todo = [(tree, "")]
    while todo:
        n, at = todo.pop()
        yield n, at
        todo += [(c, f"{at}/{c.sign}") for c in reversed(n.children)]


def _within(low: str, high: str) -> str:
    """The path that all paths from the least to the greatest lie in, each ended by "/"."""
    same = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
    return low[: low.rfind("/", 0, same) + 1]


def induce(pages: list[str | None]) -> tuple[list[str], str]:
    """The wrapper of a layout from its pages: marks of template nodes (path and text), path of the content slot,
    which is the lowest one that all parents of varying text lie in ("/" for the whole page). A text that varies in its digits
    only, such as a counter or a date, doesn't widen the slot."""
    if len(pages) < 2:
        return [], ""
    first = Reference(pages[0])
    shown = [first.compare(p) for p in pages[1:]]
    paths = [v for _, v in shown if v is not None]
    return first.wrapper(Counter(h for hits, _ in shown for h in hits), len(shown), _within(min(paths), max(paths)) if paths else None)


def main_text(html: str | None, constant: frozenset[str] = frozenset(), slot: str = "") -> str:
    """The blocks of the content region less template nodes, joined by one space. The region is the page's article or main
    elements; without them the wrapper's content slot; without that the whole page, in which all text blocks lie. A page
    whose article or main elements hold template nodes only keeps them."""
    root = parse(html)
    regions: list[tuple[Node, str]] = []

    def seek(n: Node, at: str, tags: tuple) -> None:
        for c in n.children:
            if not c.drop:
                if c.tag in tags:
                    regions.append((c, f"{at}/{c.sign}"))
                else:
                    seek(c, f"{at}/{c.sign}", tags)

    seek(root, "", ("article",))
    if any(not n.hint for n, _ in regions):
        regions = [(n, at) for n, at in regions if not n.hint]  # next to articles, those named as teasers are none
    if not regions:
        seek(root, "", ("main",))
    explicit = bool(regions)
    if not regions:

        def find(n: Node, at: str) -> None:
            if at == slot:
                regions.append((n, at))
            for c in n.children:
                if not c.drop:
                    find(c, f"{at}/{c.sign}")

        find(root, "")
        regions = regions or [(root, "")]
    out: list[str] = []

    def blocks(n: Node, at: str, constant: frozenset[str]) -> None:
        template = bool(constant) and bool(t := n.text()) and _mark(at, t) in constant
        text: list[str] = []

        def flush() -> None:
            if t := " ".join("".join(text).split()):
                out.append(t)
            text.clear()

        for p in n.parts:
            if isinstance(p, str):
                if not template:
                    text.append(p)
            elif not p.drop:
                flush()
                blocks(p, f"{at}/{p.sign}", constant)
        flush()

    for n, at in regions:
        blocks(n, at, constant)
    if explicit and not out:
        for n, at in regions:
            blocks(n, at, frozenset())
    return " ".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page, by a wrapper for each layout of a host.

    Returns page_id, url, text, n_chars. All different pages of a layout of a host (pages of the same outer containers; layouts
    of a single page are put together) are aligned with the first of them, by a hash, by simple tree matching of whole trees;
    matched nodes of equal text become template, all other text is varying, and the lowest element around all of it is the
    content slot. All pages are then read by their layout's wrapper: article and
    main elements give the region only, template text goes from there too (text that stands in 60 % of the other pages, in
    two of them at least).
    Navigation, headers, footers, asides, scripts, styles and elements whose role says so are left out everywhere; so are forms,
    but those with at least 80 characters of text for each input or more than half of the page's text, and elements whose class or
    id names readers' comments or hints at adverts or notices, unless they are an article, main or heading, hold more than half of
    the page's text (adverts and notices) or all but a tenth of their article's. Elements nested deeper than 256 lose their
    borders, not their text. Null html: empty text. A null or odd url is a host of its own name ''.
    Rows that repeat an id are read each; no pages, no rows. Other columns are not read.
    """
    pages = bounded(pages)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    kind = pages.schema[id_col].dataType.simpleString()

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([None if h is None else layout(h) for h in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "layout"])

    raw = rows.where("html is not null").select("host", F.xxhash64("html").alias("n"), "html")
    rows = rows.mapInArrow(frame, f"page_id {kind}, url string, html string, host string, layout long")
    # different pages only: copies would agree in everything
    different = stage(rows.where("html is not null").select("host", "layout", F.xxhash64("html").alias("n")).distinct(), "pages")
    many = stage(different.groupBy("host", "layout").agg(F.count("*").alias("many")).where("many > 1").select("host", "layout", F.lit(True).alias("many")), "layouts")
    common = F.coalesce(F.when(F.col("many"), F.col("layout")), F.lit(0)).alias("common")  # 0: the layouts of one page, put together
    keys = different.join(small(many, 100), ["host", "layout"], "left").select("host", "n", common).groupBy("host", "common").agg(F.min("n").alias("n"), F.count("*").alias("pages")).where("pages > 1")
    first = stage(raw.join(small(stage(keys, "keys"), 100), ["host", "n"]).groupBy("host", "common", F.col("n").alias("first"), "pages").agg(F.first("html").alias("reference")), "references")
    size = first.agg(F.max(F.octet_length("reference") + F.length("host") + 64)).first()[0] or 0

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = lru_cache(REFERENCES)(Reference)
        for batch in batches:
            found = [reference(r).compare(h) for h, r in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([x for _, x in found], pa.string())], names=["host", "common", "n", "hits", "vary"])

    # every page is compared where it stands, and goes on as the numbers of the nodes that it shares; copies go then
    paged = rows.where("html is not null").join(small(many, 100), ["host", "layout"], "left").select("host", common, F.xxhash64("html").alias("n"), "html")
    paged = paged.join(small(first, size), ["host", "common"]).where("n <> first").select("host", "common", "n", "html", "reference")
    shown = stage(paged.mapInArrow(compare, "host string, common long, n long, hits array<int>, vary string").dropDuplicates(["host", "common", "n"]), "shown")
    counts = shown.select("host", "common", F.explode("hits").alias("hit")).groupBy("host", "common", "hit").agg(F.count("*").alias("many"))
    counts = counts.groupBy("host", "common").agg(F.collect_list(F.struct("hit", "many")).alias("counts"))  # three a node of the reference
    paths = shown.groupBy("host", "common").agg(F.min("vary").alias("low"), F.max("vary").alias("high"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Reference(x["reference"]).wrapper({c["hit"]: c["many"] for c in x["counts"] or ()}, x["pages"] - 1, None if x["low"] is None else _within(x["low"], x["high"])) for x in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.list_(pa.string())), pa.array([x for _, x in found], pa.string())], names=["host", "common", "constant", "slot"])

    whole = first.join(counts, ["host", "common"], "left").join(paths, ["host", "common"], "left").select("host", "common", "reference", "pages", "counts", "low", "high")
    wrappers = whole.mapInArrow(wrap, "host string, common long, constant array<string>, slot string")
    wrappers = stage(wrappers.where("size(constant) > 0 or slot <> ''"), "wrappers")
    widest = wrappers.agg(F.max(F.size("constant") * 40 + F.length("slot") + F.length("host") + 64)).first()[0] or 0

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, frozenset(c or ()), s or "") for h, c, s in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = rows.join(small(many, 100), ["host", "layout"], "left").withColumn("common", common)
    joined = rows.join(small(wrappers, widest), ["host", "common"], "left").select("page_id", "url", "html", "constant", "slot")
    return joined.mapInArrow(read, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))

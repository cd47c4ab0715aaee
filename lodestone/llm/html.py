"""Main text of web pages by composite text density.

Every node of a page's tree gets its characters C, tags T, link characters LC and link
tags LT (each at least 1 below a fraction). With LCb and Cb of the body and b the
logarithm's base, its density is

    C / T * log_b(C / LC * T / LT),   b = ln(C / (C - LC) * LC + LCb / Cb * C + e)

The subtree whose children's densities have the largest sum is the article's core. The
article is the highest node over it that adds prose only: an ``article`` element is
climbed to in any case, another node if what it adds is unmarked, no block of links and
all in paragraphs, headings, lists and the like. Of the article everything stays but
marked parts (and, outside ``article`` elements, blocks that are nothing but several
links). The least density and the least characters per tag on the core's path up to the
body, times NEAR, are the thresholds at which a neighbour outside the article belongs to
it as well, bare text included; so does a heading before it. Other neighbours go.

Elements that the contract names (menus, headers, footers, sidebars, forms, scripts,
styles) and hidden ones are cut off first; a form that holds most of the page's text is
a wrapper and stays. A class, id or role that speaks of adverts, notices, comments and
the like is only a weight: it divides the node's density by MARKED, unless the node
holds most of the page's text in blocks, or a first heading, or is a paragraph as dense
as the plain ones beside it. Marked nodes whose density is under the largest one of the
path are left out. If all of the text is marked, marks count for nothing.

Defined cases: null or empty html, and a page without text, give an empty text;
unclosed and misnested tags are closed as a browser would for the common elements;
a page without any markup is one block; parsing and selecting take time in proportion
to the page, however deep or misnested it is; rows are handled one by one, so repeated
rows and null ids are no matter; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbuf as T

#: Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROP = frozenset("head script style noscript template iframe nav header footer aside form button select textarea input dialog menu svg canvas object title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: An opening tag on the left closes an open element on the right, up to the scope's bounds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"}}
SCOPE = frozenset("ul ol dl table select article section main div body html td th blockquote".split())
#: Words of a class or id that speak of what is no article.
BOILERPLATE = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment commentlist comments cookie cookies consent disqus footer header masthead menu nav navbar navigation newsletter notice popup promo promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Elements whose text is prose wherever they stand, and those that are one paragraph of it.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table address hr".split())
PARAGRAPH = frozenset("p blockquote pre h2 h3 h4 h5 h6".split())
#: A marked node's density is divided by it.
MARKED = 20.0
#: The share of the path's least density that a neighbour needs.
NEAR = 0.5
HEADINGS, TITLES = frozenset("h1 h2 h3".split()), frozenset("h1 article main".split())

BOUNDS = SCOPE | {"head", "thead"}
_ENDS = frozenset().union(SCOPE, {"p"}, *CLOSES.values())
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_WORD = re.compile(r"[a-z0-9]+")
_WHITE = re.compile(r"\s+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")


class Node:
    __slots__ = ("name", "parent", "end", "kids", "drop", "marked", "chars", "tags", "link_chars", "link_tags", "blocks", "titles", "prose", "quoted", "density", "total")

    def __init__(self, name: str, parent: Node | None, attrs: str = ""):
        self.name, self.parent, self.kids = name, parent, []
        # the nearest node up from here, itself included, that a tag may close or that bounds closing
        self.end = self if parent is None or name in _ENDS else parent.end
        self.drop = name in DROP
        self.marked = False
        if attrs and not self.drop:
            self._attributes(attrs)

    def _attributes(self, attrs: str) -> None:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id") and self.name not in ("html", "body", "article", "main"):
                # a word counts at either end of a class's name
                ends = {w for token in value.split() for pieces in (_WORD.findall(token),) if pieces for w in (pieces[0], pieces[-1])}
                self.marked |= not BOILERPLATE.isdisjoint(ends)
            elif key == "role":
                self.marked |= value in ROLES
            elif key == "aria-hidden":
                self.drop |= value == "true"
        self.drop |= bool(_HIDDEN.search(attrs))


def parse(html: str) -> Node:
    """The tree; texts are str kids, their character references decoded."""
    root = here = Node("#root", None)
    open_names: dict[str, int] = {}

    def shut(node: Node, up: Node) -> Node:
        """Closes what is open from node up to ``up``; returns the parent of ``up``."""
        while node is not up.parent:
            open_names[node.name] -= 1
            node = node.parent
        return node

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        m = None
        while lt >= 0 and not (m := _MARKUP.match(html, lt)):
            lt = html.find("<", lt + 1)
        text = html[at : lt if lt >= 0 else n]
        if text:
            here.kids.append(unescape(text))
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if open_names.get(name):  # an end tag without an open element is nothing
                node = here
                while node.name != name:
                    node = node.parent
                here = shut(here, node)
            continue
        if name in BLOCK and here.end.name == "p":  # a block ends an open paragraph
            here = shut(here, here.end)
        if name in CLOSES:
            node, end = here.end, None
            while node.parent is not None and (node.name in CLOSES[name] or node.name not in BOUNDS):
                if node.name in CLOSES[name]:
                    end = node
                node = node.parent.end
            if end is not None:
                here = shut(here, end)
        node = Node(name, here, m[3])
        here.kids.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            end = close.start() if close else n
            node.kids.append(html[at:end])
            at = html.find(">", end) + 1 or n if close else n
        elif name not in VOID:
            here = node
            open_names[name] = open_names.get(name, 0) + 1
    return root


def _ordered(root: Node) -> list[Node]:
    """The nodes that are kept, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.drop)
    return out


def _counts(nodes: list[Node]) -> None:
    for x in reversed(nodes):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        x.blocks = x.titles = False  # whether such elements are under it
        x.prose = x.name in PROSE or x.name in BLOCK and not any(isinstance(k, str) and not k.isspace() for k in x.kids)
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len(_WHITE.sub(" ", k).strip())
            elif not k.drop:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags
                x.blocks |= k.blocks or k.name in BLOCK
                x.titles |= k.titles or k.name in TITLES
                x.prose &= x.name in PROSE or k.prose or not k.chars
        if x.name == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    plain, links = max(1, chars - link_chars), max(1, link_chars)
    tags, link_tags = max(1, tags), max(1, link_tags)
    base = log(chars / plain * links + share * chars + e)
    return chars / tags * log(chars / links * tags / link_tags) / log(base)


def _lines(node: Node):
    """The runs of texts and inline elements between the blocks right under a node."""
    run = []
    for k in node.kids:
        if isinstance(k, Node) and k.name in BLOCK:
            if run:
                yield run
            run = []
        elif isinstance(k, str) and not k.isspace() or isinstance(k, Node) and not k.drop and k.chars:
            run.append(k)
    if run:
        yield run


def _measures(run: list, share: float) -> tuple[float, float]:
    """Characters per tag and density of a run of texts and inline elements."""
    chars = sum(len(_WHITE.sub(" ", k).strip()) if isinstance(k, str) else k.chars for k in run)
    inner = [k for k in run if isinstance(k, Node)]
    tags = sum(k.tags + 1 for k in inner)
    return chars / max(1, tags), _density(chars, tags, sum(k.link_chars for k in inner), sum(k.link_tags for k in inner), share)


class Page:
    """A parsed page with its counts, densities and article."""

    def __init__(self, html: str, marks: bool = True):
        root = parse(html)
        self.body = self._wrappers(root)
        body = self.body
        self.share = body.link_chars / max(1, body.chars)
        most = (body.chars - body.link_chars) / 2
        plain: dict[int, float] = {}
        for x in self.nodes:
            # parents come first, so a mark holds for all that is under it
            x.quoted = x.parent is not None and x.parent.quoted or x.name == "article"
            if x.marked and x.name in PARAGRAPH and x.parent is not None and not x.parent.marked:
                x.marked = not self._like_its_neighbours(x, plain)
            x.marked = marks and (x.marked or x.parent is not None and x.parent.marked) and not (x.chars - x.link_chars > most and x.blocks or x.titles)
            x.density = _density(x.chars, x.tags, x.link_chars, x.link_tags, self.share) / (MARKED if x.marked else 1)
        for x in self.nodes:
            # emphasis and links are part of their block, no pieces of an article by themselves
            x.total = sum(k.density for k in x.kids if isinstance(k, Node) and not k.drop and k.name in BLOCK)
            x.total += sum(_measures(run, self.share)[1] for run in _lines(x)) if x.name in BLOCK or x is body else 0.0
            x.total /= MARKED if x.marked else 1
        inside = _ordered(body)
        self.best = max((x for x in inside if x.name in BLOCK or x is body), key=lambda x: x.total, default=body)
        self.path, node = [], self.best
        while node is not body:
            self.path.append(node)
            node = node.parent
        self.path.append(body)
        self.least = NEAR * min(x.density for x in self.path)
        self.least_plain = NEAR * min(x.chars / max(1, x.tags) for x in self.path)
        self.most = max(x.density for x in self.path)
        self.top = 0  # the article's place in the path
        for i, (child, node) in enumerate(zip(self.path, self.path[1:]), 1):
            if node.marked:
                break
            if node.name == "article" or self.top == i - 1 and self._adds_prose(node, child):
                self.top = i

    def _wrappers(self, root: Node) -> Node:
        """The body, after forms that hold most of the page's text were opened."""
        dropped = [x for x in _all_nodes(root) if x.name == "form" and x.drop]
        for x in dropped:
            x.drop = False
        self.nodes = _ordered(root)
        _counts(self.nodes)
        body = next((x for x in self.nodes if x.name == "body"), root)
        most = (body.chars - body.link_chars) / 2
        kept = set(map(id, self.nodes))
        closed = [x for x in dropped if id(x) not in kept or x.chars - x.link_chars <= most]
        for x in closed:
            x.drop = True
        if closed:
            self.nodes = _ordered(root)
            _counts(self.nodes)
        return body

    def _like_its_neighbours(self, x: Node, plain: dict[int, float]) -> bool:
        """Whether a marked paragraph is as dense as the least of at least two unmarked ones beside it, times NEAR."""
        if id(x.parent) not in plain:
            beside = [k for k in x.parent.kids if isinstance(k, Node) and not (k.drop or k.marked) and k.name in PARAGRAPH and k.chars]
            least = min((_density(k.chars, k.tags, k.link_chars, k.link_tags, self.share) for k in beside), default=0.0)
            plain[id(x.parent)] = NEAR * least if len(beside) > 1 else float("inf")
        return _density(x.chars, x.tags, x.link_chars, x.link_tags, self.share) >= plain[id(x.parent)]

    @staticmethod
    def _links(x: Node) -> bool:
        return x.name not in HEADINGS and 2 * x.link_chars > x.chars > 0

    def _adds_prose(self, node: Node, child: Node) -> bool:
        """Whether all that a node has beside a child is unmarked prose."""
        for k in node.kids:
            if isinstance(k, str):
                if not k.isspace():
                    return False
            elif k is not child and not k.drop and k.chars and (k.marked or self._links(k) or not k.prose):
                return False
        return True

    def left_out(self, x: Node) -> bool:
        """Whether a block inside the article is no part of it."""
        return x.marked and x.density < self.most or not x.quoted and x.name in BLOCK and x.link_tags > 2 and x.link_chars >= x.chars > 0

    def near(self, plain: float, density: float) -> bool:
        return density >= self.least and plain >= self.least_plain

    def blocks(self) -> list[str]:
        """The article's blocks in page order: down the path, the article, and up again."""
        out, after = [], []
        path = self.path[self.top :]
        for node, child in zip(path[:0:-1], path[-2::-1], strict=True):
            before, behind = self._sides(node, child)
            out += before
            after.append(behind)
        out += block_texts(path[0], self.left_out)
        return out + [t for behind in reversed(after) for t in behind]

    def _sides(self, node: Node, child: Node) -> tuple[list[str], list[str]]:
        """The texts of the neighbours of the path that belong to the article: those before and those after it."""
        sides: tuple[list[str], list[str]] = [], []
        side, line = 0, []

        def flush():
            if line and self.near(*_measures(line, self.share)) and any(isinstance(k, str) for k in line):
                holder = Node("div", node)
                holder.kids = list(line)
                sides[side].extend(block_texts(holder, self.left_out))
            line.clear()

        for k in node.kids:
            if isinstance(k, Node) and (k.name in BLOCK or k is child):
                flush()
                if k is child:
                    side = 1
                elif not k.drop and k.chars > k.link_chars and not self.left_out(k) and (self.near(k.chars / max(1, k.tags), k.density) or not side and _heading(k)):
                    sides[side].extend(block_texts(k, self.left_out))
            elif isinstance(k, str) and not k.isspace() or isinstance(k, Node) and not k.drop and k.chars:
                line.append(k)
        flush()
        return sides


def _all_nodes(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(k for k in node.kids if isinstance(k, Node))


def _heading(x: Node) -> bool:
    """Whether all text under an unmarked node is that of headings."""
    return not x.marked and x.chars > 0 and x.chars == sum(k.chars for k in _ordered(x) if k.name in HEADINGS)


def block_texts(node: Node, left_out) -> list[str]:
    """The blocks under a node: white space made one space, trimmed, empty ones left out."""
    out, line = [], []

    def flush():
        text = _WHITE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    stack: list[tuple[object, bool]] = [(node, False)]
    while stack:
        x, closing = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif x.name == "br":
            line.append(" ")
        else:
            if x.name in BLOCK:
                flush()
            if not closing:
                stack.append((x, True))
                stack.extend((k, False) for k in reversed(x.kids) if isinstance(k, str) or not (k.drop or left_out(k)))
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return "\n".join(Page(html).blocks() or Page(html, marks=False).blocks())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""

    def run(batches):
        for cut, raw in T.pieces(batches, "html"):
            text = [main_text(x.decode("utf-8", "replace")) for x in raw]
            yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))

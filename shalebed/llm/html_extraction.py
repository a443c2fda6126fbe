"""Main text of web pages by scoring the element tree.

Paragraphs pass points for their length and commas to their ancestors, less at
each level; an element's points are discounted by the share of its text that is
in links, and by names that speak for and against it. The best container is kept
with all text beside it that has few links; lists of links in it go, with their
headings. Elements that are never the article (scripts, menus, forms, or one
whose class ends in "sidebar" or "comments") are taken out before; of a form
around the article or around most of the page's text, only the controls are. An
id alone speaks against a part of the article only with a second sign, as it is
often the heading's own words: an article may have a section "related-work".

A paragraph's points reach its container and the four containers or other
elements above it: in full, then a half, a quarter, a sixth and an eighth.

A page is read once from left to right, in time proportional to its length
whatever stands in it, and scored alone, so this is one map over the rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrow_words import blocks
from .common import extended, table

# Facts of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Start tags that end an open element of these names, up to a border.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "title"}
CONTAINERS = frozenset("body article main section div td blockquote center figure details ul ol dl table form fieldset li dd".split())

#: Elements that never hold the article.
NEVER = frozenset(
    "head script style noscript template iframe object embed svg canvas math audio video map nav aside footer form button select textarea input "
    "label dialog menu datalist fieldset title".split()
)
#: Those of them that pages put around the article all the same.
AROUND = frozenset(("form", "fieldset"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
#: Parts of class and id names that mark what isn't the article.
STRONG = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promoted promotion comment comments disqus respond reply replies sidebar "
    "sidebars cookie cookies consent gdpr footer nav navbar navigation menu breadcrumb breadcrumbs share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login popup modal overlay pagination pager masthead toolbar outbrain taboola skip paywall "
    "disclaimer copyright trending banner notice notices notification alert widget widgets".split()
)
#: Beginnings and ends of such parts that are written together.
STRONG_STARTS = ("comment", "cookie", "advert", "adsense", "sponsor", "newsletter", "breadcrumb", "subscri", "sidebar", "navbar", "sharebar", "relatedpost")
STRONG_ENDS = ("nav", "menu", "sidebar", "comments", "advert", "footer")
#: Words that names of such parts are made with, besides.
FRAME = frozenset(
    "main top bottom left right inner outer wrap wrapper container box area block list thread section part item bar head title link links row col column "
    "slot unit first second page site content form post posts articles stories button buttons icons panel region group mobile desktop".split()
)
WEAK = frozenset("header side rail aside search form tags meta toc hidden".split())
GOOD = frozenset("article content body main entry post text story page blog".split())

#: A start tag: a name, then values behind = (quoted ones may hold < and >) and anything else. Nothing is tried twice.
_TAG = re.compile(r"<([A-Za-z][^\s/><]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>][^\s<>]*+)?+|[^=<>]++)*+)>")
_END_TAG = re.compile(r"</([A-Za-z][^\s/><]*+)[^<>]*+>")
_ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    __slots__ = ("name", "attrs", "parent", "children", "points", "chars", "linked", "gone", "factor")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []
        self.points, self.chars, self.linked, self.gone, self.factor = 0.0, 0, 0, False, 1.0


class _Open:
    """The open elements, with the depths of each name and of the blocks."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.depths: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.name, []).append(len(self.stack))
        if node.name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, name: str) -> int:
        found = self.depths.get(name)
        return found[-1] if found else 0

    def close(self, depth: int) -> None:
        """Closes the element of a depth and all in it."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.depths[node.name].pop()
            if node.name in BLOCK:
                self.blocks.pop()

    def end(self, name: str) -> None:
        depth = self.last(name)
        # An inline end tag doesn't close blocks around it.
        if depth and (name in BLOCK or depth > self.blocks[-1]):
            self.close(depth)

    def begin(self, name: str) -> None:
        """Closes what a start tag of this name ends."""
        if name in ENDS_P and self.last("p") == self.blocks[-1] > 0:
            self.close(self.blocks[-1])
        if name in CLOSES:
            names, borders = CLOSES[name]
            border = max(map(self.last, borders))
            within = [own[at] for n in names if (own := self.depths.get(n)) and (at := bisect_right(own, border)) < len(own)]
            if within:
                self.close(min(within))


def parse(page: str) -> Node:
    """The element tree of a page, however broken; text is decoded once. A tag
    that doesn't end is text; a comment or script that doesn't end is the rest.
    """
    root = Node("#root", {}, None)
    opened = _Open(root)
    at = begun = 0
    ends: dict[str, int] = {}  # by what ends something: where it was found last

    def find(what: str, start: int) -> int:
        """Where what stands next, or the end; each stretch is searched once."""
        known = ends.get(what, -1)
        if known < start:
            known = page.find(what, start)
            ends[what] = known = len(page) if known < 0 else known
        return known

    def add(to: int) -> None:
        if to > begun:
            opened.stack[-1].children.append(html.unescape(page[begun:to]))

    while (at := page.find("<", at)) >= 0:
        mark = page[at + 1 : at + 2]
        if mark == "!" or mark == "?":
            add(at)
            if page.startswith("<!--", at):
                begun = at = min(len(page), find("-->", at + 4) + 3)
            elif page.startswith("<![CDATA[", at):
                to = find("]]>", at + 9)
                if to > at + 9:
                    opened.stack[-1].children.append(page[at + 9 : to])
                begun = at = min(len(page), to + 3)
            else:
                begun = at = min(len(page), find(">", at) + 1)
            continue
        m = None
        if find(">", at) < len(page):
            m = (_END_TAG if mark == "/" else _TAG).match(page, at)
        if not m:
            at += 1
            continue
        add(at)
        begun = at = m.end()
        name = m[1].lower()
        if mark == "/":
            opened.end(name)
            continue
        opened.begin(name)
        attrs = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m[2])} if m[2] else {}
        here = opened.stack[-1]
        node = Node(name, attrs, here)
        here.children.append(node)
        if name in RAW:
            close = None
            if ends.get(f"</{name}", 0) <= len(page):
                close = re.compile(rf"</{name}\s*+(?:>|$)", re.I).search(page, at)
            if close:
                begun = at = close.end()
            else:
                ends[f"</{name}"] = len(page) + 1  # none follows
                if name in ("script", "style"):
                    begun = at = len(page)
        elif name not in VOID:
            opened.push(node)
    add(len(page))
    return root


_ARTICLE = frozenset(("article", "main"))
_READERS = frozenset("comment comments disqus respond reply replies".split())
_H = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTROLS = frozenset("form button input select textarea".split())
_WORD = re.compile(r"[a-z]+|\d+")


def _kind(part: str) -> str:
    if part in STRONG or part.startswith(STRONG_STARTS) or part.endswith(STRONG_ENDS):
        return "strong"
    return "good" if part in GOOD else "weak" if part in WEAK else ""


def _names(node: Node, with_id: bool = True) -> set[str]:
    """What the class and id say: for each name the last part that says anything
    ("good" of alert-story, "strong" of story-alert), "mixed" for a good one with
    a strong part, and "readers".
    """
    found: set[str] = set()
    for name in f"{node.attrs.get('class', '')} {node.attrs.get('id', '') if with_id else ''}".split():
        parts = [x.lower() for x in _PART.findall(name)]
        kinds = [k for k in map(_kind, parts) if k]
        if kinds:
            found.add(kinds[-1])
            if kinds[-1] == "good" and "strong" in kinds:
                found.add("mixed")
        if any(x in _READERS or x.startswith("comment") for x in parts):
            found.add("readers")
    return found


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", attrs.get("style", "")))


def _unwanted(node: Node, names: set[str], in_article: bool) -> bool:
    name, attrs = node.name, node.attrs
    if name in NEVER:
        return True
    if name == "header":
        return not in_article
    if not attrs:
        return False
    if _hidden(attrs):
        return True
    if name in ("html", "body", "main"):
        return False
    return attrs.get("role", "").lower() in ROLES or "strong" in names or "readers" in names or "weak" in names and "good" not in names


class _Facts:
    """What is in each element: the characters of text outside of links and of
    NEVER elements but AROUND; all of them and those in links to other pages;
    its first heading, how many headings are such links, and whether it has
    controls. And the elements that hold an article.
    """

    def __init__(self, root: Node):
        every, todo = [], [root]
        while todo:
            node = todo.pop()
            every.append(node)
            todo += [c for c in node.children if isinstance(c, Node)]
        self.sizes: dict[Node, int] = {}
        self.holds: set[Node] = set()
        self.chars: dict[Node, int] = {}
        self.linked: dict[Node, int] = {}
        self.heading: dict[Node, Node] = {}
        self.teasers: dict[Node, int] = {}
        self.controls: set[Node] = set()
        self._words: dict[Node, set[str]] = {}
        for node in reversed(every):
            if (node.name not in NEVER or node.name in AROUND) and node.name != "a":
                self.sizes[node] = sum(len(c.strip()) if isinstance(c, str) else self.sizes.get(c, 0) for c in node.children)
            own = [c for c in node.children if isinstance(c, Node)]
            self.chars[node] = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(self.chars[c] for c in own)
            away = node.name == "a" and not node.attrs.get("href", "#").startswith("#")
            self.linked[node] = self.chars[node] if away else sum(self.linked[c] for c in own)
            if node.name in _H:
                self.heading[node] = node
                self.teasers[node] = int(2 * self.linked[node] > self.chars[node])
            else:
                self.teasers[node] = sum(self.teasers[c] for c in own)
                if first := next((self.heading[c] for c in own if c in self.heading), None):
                    self.heading[node] = first
            if node.name in _CONTROLS or any(c in self.controls for c in own):
                self.controls.add(node)
            if node.parent is not None and (node in self.holds or node.name in _ARTICLE and "strong" not in _names(node)):
                self.holds.add(node.parent)

    def names_itself(self, node: Node, inside: bool) -> bool:
        """Whether an id only names a part of the article: that of a heading; one
        whose words are in the heading below it; within an article, one with words
        that aren't those of a page's frame. Not with a second sign: links
        elsewhere, controls, teasers, or no words but of readers' comments.
        """
        if node.name in _H:
            return True
        parts = [x.lower() for x in _PART.findall(node.attrs.get("id", ""))]
        telling = [x for x in parts if not (x in FRAME or x.isdigit())]
        if node in self.controls or self.teasers[node] > 1 or 5 * self.linked[node] > self.chars[node]:
            return False
        if all(x in _READERS or x.startswith("comment") and x.endswith("list") for x in telling):
            return False
        if (heading := self.heading.get(node)) is not None:
            if heading not in self._words:
                self._words[heading] = set(_WORD.findall(_plain(heading).lower()))
            if self._words[heading].issuperset(parts):
                return True
        return inside and not all(map(_kind, telling))


def _walk(root: Node) -> list[Node]:
    """All nodes that may be the article's, parents first; others are marked gone."""
    facts = _Facts(root)
    sizes, holds = facts.sizes, facts.holds
    order, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        names = _names(node) if node.attrs else set()
        if names - {"good"} and "id" in node.attrs and facts.names_itself(node, inside):
            names = _names(node, with_id=False)
        if node.parent is not None and _unwanted(node, names, inside):
            # A wrapper of the article or of most text isn't taken out for its name, unless readers wrote it.
            wrapper = (node.name not in NEVER or node.name in AROUND) and node.name != "header" and "hidden" not in node.attrs and "readers" not in names
            most = 0.5 if node.name in AROUND else 0.6
            if not (wrapper and (node in holds or sizes.get(node, 0) > most * sizes[root])):
                node.gone = True
                continue
        if "mixed" in names:
            node.factor = 0.3
        order.append(node)
        inside = inside or node.name in _ARTICLE
        todo += [(c, inside) for c in reversed(node.children) if isinstance(c, Node)]
    return order


def _score(root: Node, order: list[Node]) -> None:
    for node in reversed(order):  # children first
        own = 0
        for child in node.children:
            if isinstance(child, str):
                own += len(child.strip())
            elif not child.gone:
                node.chars += child.chars
                node.linked += child.chars if child.name == "a" else child.linked
        node.chars += own
    for node in order:
        text = ""
        if node.name in ("p", "pre", "td", "blockquote", "li", "dd", "h2", "h3"):
            text = _plain(node)
        elif node.name in CONTAINERS:
            text = " ".join(c for c in node.children if isinstance(c, str)).strip()
        if len(text) < 2 or node.chars == 0:
            continue
        points = (min(len(text), 25) / 25) * (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - node.linked / node.chars)
        up = node if node.name in CONTAINERS and node.name not in ("td", "li", "dd", "blockquote") else node.parent
        level = 1
        while up is not None and up.parent is not None and level <= 5:
            up.points += points / (level if level < 3 else 2 * level - 2)
            up, level = up.parent, level + 1


def _plain(node: Node) -> str:
    """The text of a block without nested blocks."""
    out: list[str] = []
    todo: list[Node | str] = [*reversed(node.children)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.gone:
            if x.name == "br":
                out.append(" ")
            elif x.name not in BLOCK:
                todo += reversed(x.children)
    return "".join(out).strip()


def _texts(nodes: list[Node]) -> list[str]:
    """The blocks of text of these nodes, in page order."""
    found: list[str] = []
    part: list[str] = []

    def close() -> None:
        if text := " ".join("".join(part).split()):
            found.append(text)
        part.clear()

    for top in nodes:
        todo: list[Node | str | None] = [top]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                part.append(x)
            elif not x.gone:
                if x.name == "br":
                    part.append(" ")
                elif x.name in BLOCK:
                    close()
                    todo.append(None)
                    todo += reversed(x.children)
                else:
                    todo += reversed(x.children)
        close()
    return found


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _parts(parent: Node, best: Node | None) -> list[list[Node | str]]:
    """The children of a container; texts and inline elements that follow each other are one."""
    out: list[list[Node | str]] = []
    inline = False
    for child in parent.children:
        if child.gone if isinstance(child, Node) else not child.strip() and not inline:
            continue
        before, inline = inline, child is not best and (isinstance(child, str) or child.name not in BLOCK)
        if before and inline:
            out[-1].append(child)
        else:
            out.append([child])
    return out


def _links(nodes: list[Node | str]) -> float:
    """The share of their text that is in links."""
    chars = sum(len(n.strip()) if isinstance(n, str) else n.chars for n in nodes)
    linked = sum(n.chars if n.name == "a" else n.linked for n in nodes if isinstance(n, Node))
    return linked / chars if chars else 0.0


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())
_LISTS = frozenset("ul ol dl table div section menu".split())


def _kept(parent: Node, best: Node | None, worth: dict[Node, float], least: float) -> list[Node]:
    """The children of a container that are the article's: best; what is worth
    the least; and what has few links, unless its name speaks against it or it is
    another article. Without a best one, all but lists of links. A heading stays
    with what follows it.
    """
    kept: list[Node] = []
    stays = False  # what follows
    for own in reversed(_parts(parent, best)):
        n = own[0]
        element = isinstance(n, Node)
        if best is None:
            stay = not (element and n.name in _LISTS) or _links(own) < 0.5
        else:
            alike = element and n.name in CONTAINERS and worth.get(n, 0.0) >= least
            stay = n is best or alike or _links(own) < 0.25 and not (element and (n.name == "article" or n.factor < 1))
        if element and n.name in _HEADINGS and n is not best:
            stay = stays and _links(own) < 0.5
        elif element and n.chars == 0:
            continue  # says nothing, so a heading before it looks further
        stays = stay
        if stay:
            if n is not best and (not element or n.name not in BLOCK):
                n = Node("span", {}, None)
                n.children = own
            kept.append(n)
    return kept[::-1]


def main_text(page: str) -> str:
    """The article of a page, blocks joined by one space; empty if there is none."""
    root = parse(page)
    order = _walk(root)
    _score(root, order)
    worth = {n: n.points * (1 - _density(n)) * n.factor for n in order}
    ranked = {n: worth[n] + (25.0 * (1 - _density(n)) * n.factor if n.name in _ARTICLE and n.chars else 0.0) for n in order if n.name in CONTAINERS}
    candidates = [n for n, w in ranked.items() if w > 0]
    if not candidates:
        body = next((n for n in order if n.name == "body"), root)
        return " ".join(_texts([body])) if _density(body) < 0.5 else ""
    best = max(candidates, key=ranked.__getitem__)
    # A part of an article stands for all of it.
    node = best
    while node is not None:
        if node.name == "article":
            best = node
        node = node.parent
    if best.name == "article" and best.parent is not None and best.parent.name != "main":
        # Further articles beside it are kept if they score alike.
        own = [n for n in best.parent.children if isinstance(n, Node) and not n.gone and n.name == "article"]
        return " ".join(_texts([n for n in own if n is best or worth[n] >= 0.2 * worth[best]]))
    least = 0.2 * max(worth[best], 1e-9)
    # Wrappers of nothing else stand for what is in them.
    while best.name != "main" and best.parent.parent is not None and best.parent.name != "html" and best.parent.chars == best.chars:
        best = best.parent
    if best.name in ("main", "body", "html") or best.parent is None:
        return " ".join(_texts(_kept(best, None, worth, least)))
    return " ".join(_texts(_kept(best.parent, best, worth, least)))


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points) instead of the html column.

    White space in a block becomes one space, blocks are joined by one. A null
    or empty page has an empty text. Whole pages are read; nothing is cut off.
    Repeated rows are done one by one; other columns pass through, but for text
    and n_chars, which are replaced.
    """
    pages = pages.drop(*[c for c in ("text", "n_chars") if c != column])
    names = [c for c in pages.columns if c != column]

    def run(batches):
        for part, texts in blocks(batches, column):
            found = [main_text(t) for t in texts.to_pylist()]
            own = [part.column(part.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.mapInArrow(run, extended(pages.drop(column), "text string, n_chars long"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))

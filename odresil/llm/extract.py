"""HTML extraction by tree scoring.

A page becomes a tree of elements.  Each paragraph-like block gives points for its length and commas to its parent
(whole), grandparent (half) and further ancestors (less); an element's points are discounted by its link density.
The element with the most points is the container (its enclosing ``article`` if it has one, or else its enclosing
``main``); siblings that score near it, plain paragraphs, and headings and leads before it are kept with it.

Menus, headers, footers, side bars, notices, adverts, forms, reader comments, scripts and styles are cut by element,
role and class.  An element is no such part if the page's main part lies in it: one whose name only contains a listed
word (``share-page``), or a form, stays if it holds at least half of the page's paragraph points (reader comments
apart); any other one if it also holds an ``article`` or ``main``, or if it has ``MAIN_BLOCKS`` paragraphs and nearly all
points; one named after reader comments if no paragraph lies outside such elements.  Words after ``has-``, ``with-`` and the like say how
a page is laid out, not what an element is.  Scripts, styles, controls and hidden elements are always cut.

Cases: null or empty html gives the empty text; very long and very deep pages are read whole, in time linear in their
length; of equal containers the outermost, and the first of those, is taken; broken markup (missing end tags, a tag or
character reference cut off by the end) is read as browsers do; an empty table gives no rows; repeated pages are read
each for itself; other columns are kept, one named like the result is replaced.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import base

#: An attribute: its name, and a value in quotes or up to the next blank; a quote elsewhere is a plain character.
_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+)*+)(?:>|(\Z))""", re.S)
ATTRIBUTE = re.compile(rf"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+({_VALUE})?+)?+""")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of these names, up to the element that shuts it in.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: Elements that are never text (fixed values), and those that are no part of an article.
NEVER = frozenset("script style noscript template iframe object embed svg math canvas audio video map button select textarea input label head title noembed noframes link meta".split())
APART = frozenset("nav footer aside menu dialog".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
#: Words in class and id names that mark what is no part of an article (fixed values).
WORDS = (
    "ads? adv adverts? advertisements? adsense adslot sponsor(?:ed|s)? promos? promoted banners? nav(?:bar|igation)? menus? sidebars? side footers?"
    " site-?header masthead topbar breadcrumbs? comments? commentlist disqus respond replies reply discussion cookies? consent gdpr notices?"
    " popups? modals? overlay newsletter subscribe signup login share sharing social related recommended widgets? pagination pager toolbar skip"
    " hidden print-?only alerts?"
).replace(" ", "|")
NAMED, MARKED = re.compile(rf"(?:{WORDS})\Z", re.I), re.compile(rf"(?:\A|[_-])(?:{WORDS})(?:\Z|[_-])", re.I)
READERS = re.compile(r"(?:comments?|commentlist|disqus|respond|replies|discussion)(?:[_-](?:list|area|section|thread|wrap\w*|box|body|container))?\Z", re.I)
LAYOUT = re.compile(r"(?:has|with|without|no|is|not|hide|show)[_-]", re.I)
GOOD_NAMES = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
LEADS = re.compile(r"(?:\A|[_-])(?:lead|lede|intro|standfirst|dek|subtitle|summary|abstract)(?:\Z|[_-])", re.I)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks, and the share of a page's points, with which an element is the page's main part whatever its name.
MAIN_BLOCKS, MAIN_SHARE = 3, 0.9
#: How firmly an element is cut: for its whole page's sake only, for what it is, or always.
OPEN, WEAK, FIRM, ALWAYS = range(4)


class Node:
    __slots__ = ("tag", "names", "parent", "inside", "cut", "readers", "near", "all", "chars", "linked", "blocks", "depth")

    def __init__(self, tag: str, parent: Node | None, names: str = "", cut: int = OPEN):
        self.tag, self.names, self.parent, self.inside, self.cut = tag, names, parent, [], cut
        self.readers = bool(parent and parent.readers) or any(map(READERS.match, names.split()))
        #: Points of blocks at this element, one and two below it; points, characters, linked characters and number of all blocks in it.
        self.near, self.all, self.chars, self.linked, self.blocks = [0.0, 0.0, 0.0], 0.0, 0, 0, 0
        self.depth = parent.depth + 1 if parent else 0

    @property
    def points(self) -> float:
        a, b, c = self.near
        return a + b / 2 + c / 6 + (self.all - a - b - c) / 9


def _cut(tag: str, attributes: str, in_article: bool) -> tuple[int, str]:
    """How firmly an element is cut, and its names."""
    names, role, hidden = "", "", False
    seen = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value[1:-1] if value[:1] in ("'", '"') else value
        if name in seen:  # the first of two attributes of a name counts
            continue
        seen.add(name)
        if name in ("class", "id"):
            names += " " + value
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    if tag in ("html", "body", "article", "main"):
        return OPEN, names
    if tag in NEVER or hidden:
        return ALWAYS, names
    if tag == "header":
        return OPEN if in_article else FIRM, names
    marks = [x for x in names.split() if not LAYOUT.match(x)]
    if tag in APART or role in CUT_ROLES or any(NAMED.match(x) or READERS.match(x) for x in marks):
        return FIRM, names
    return WEAK if tag in ("form", "fieldset") or any(map(MARKED.search, marks)) else OPEN, names


class _Open:
    """The open elements, and how many of each name there are, so that an end tag without a start tag costs nothing."""

    def __init__(self, root: Node):
        self.here, self.counts = root, {}

    def enter(self, node: Node) -> None:
        self.here = node
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1

    def leave(self, node: Node) -> None:
        """Closes ``node`` and all that is open in it."""
        while self.here is not node.parent:
            self.counts[self.here.tag] -= 1
            self.here = self.here.parent

    def find(self, tags, stop=()) -> Node | None:
        """The innermost open element of one of the names, within one of the names ``stop``."""
        if not any(map(self.counts.get, tags)):
            return None
        up = self.here
        while up.parent and up.tag not in tags:
            if up.tag in stop:
                return None
            up = up.parent
        return up if up.parent and up.tag in tags else None


def parse(page: str) -> tuple[Node, list[Node]]:
    """The tree of a page and its elements in page order; text stands in ``inside`` between the children."""
    root, at = Node("html", None), 0
    nodes, open_ = [root], _Open(root)
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            open_.here.inside.append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name or m[4] is not None:  # a comment, a declaration, or a tag the end has cut off
            continue
        tag = name.lower()
        if m[1]:
            inner = () if tag in ("table", "article", "body", "html", "main", "div", "section") else ("table", "article")
            if up := open_.find((tag,), inner):
                open_.leave(up)
            continue
        attributes = m[3] or ""
        if tag == "html":
            continue
        if tag in BLOCK and open_.counts.get("p"):
            up = open_.here
            while up.parent and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                open_.leave(up)
        if tag in CLOSES and (up := open_.find(*CLOSES[tag])):
            open_.leave(up)
        in_article = bool(open_.counts.get("article") or open_.counts.get("main"))
        cut, names = _cut(tag, attributes, in_article)
        node = Node(tag, open_.here, names, cut)
        nodes.append(node)
        open_.here.inside.append(node)
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(page, at)
            node.inside.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        open_.enter(node)
    if at < len(page):
        open_.here.inside.append(page[at:])
    return root, nodes


def _blocks(node: Node, least: int) -> list[tuple[Node, str, int]]:
    """The text blocks below ``node`` in page order, but for those in elements cut at least as firmly as ``least``: the
    element that holds each, its text, its linked characters."""
    out: list[tuple[Node, str, int]] = []
    run: list[str] = []
    linked, owner = 0, node

    def end():
        nonlocal run, linked
        if run:
            text = SPACE.sub(" ", _html.unescape("".join(run))).strip()
            if text:
                out.append((owner, text, linked))
        run, linked = [], 0

    stack: list[tuple[Node, int, bool]] = [(node, 0, False)]
    while stack:
        here, k, in_link = stack.pop()
        if k == 0 and here.tag in BLOCK:
            end()
            owner = here
        if k == len(here.inside):
            if here.tag in BLOCK:
                end()
                up = here.parent
                while up and up.tag not in BLOCK:
                    up = up.parent
                owner = up or node
            continue
        stack.append((here, k + 1, in_link))
        part = here.inside[k]
        if isinstance(part, str):
            run.append(part)
            linked += len(part) if in_link else 0
        elif part.tag == "br":
            run.append(" ")
        elif part.cut < least:
            stack.append((part, 0, in_link or part.tag == "a"))
    end()
    return out


def _scored(nodes: list[Node], blocks: list[tuple[Node, str, int]], readers: bool) -> set[int]:
    """Gives the blocks' points to their elements and ancestors; the ids of the elements that got any.

    readers: whether reader comments count."""
    touched = set()
    for n in nodes:
        n.near, n.all, n.chars, n.linked, n.blocks = [0.0, 0.0, 0.0], 0.0, 0, 0, 0
    for owner, text, linked in blocks:
        if owner.readers and not readers:
            continue
        minor = owner.tag in HEADINGS or owner.tag in ("li", "th")
        points = 0.25 if minor else 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        inline = owner.tag in ("p", "pre", "blockquote", "td", "dd", "figcaption") or owner.tag[0] == "h"
        n = owner.parent if inline and owner.parent else owner
        n.near[0] += points
        n.all, n.chars, n.linked, n.blocks = n.all + points, n.chars + len(text), n.linked + linked, n.blocks + (not minor)
        touched.add(id(n))
    for n in reversed(nodes):  # children come after their parents
        if (up := n.parent) and id(n) in touched:
            up.near[1] += n.near[0]
            up.near[2] += n.near[1]
            up.all, up.chars, up.linked, up.blocks = up.all + n.all, up.chars + n.chars, up.linked + n.linked, up.blocks + n.blocks
            touched.add(id(up))
    return touched


def _spare(nodes: list[Node], root: Node) -> None:
    """Takes the cut off elements that hold the page's main part."""
    holds = set()
    for n in reversed(nodes):
        if n.parent and not n.readers and (n.tag in ("article", "main") or id(n) in holds):
            holds.add(id(n.parent))
    doubtful = [n for n in nodes if not n.readers and n.cut in (WEAK, FIRM)]
    if doubtful:
        blocks = _blocks(root, ALWAYS)
        _scored(nodes, blocks, readers=False)
        for n in doubtful:
            share = n.all / root.all if root.all else 0.0
            whole = share >= MAIN_SHARE and n.blocks >= MAIN_BLOCKS and n.linked < n.chars / 2
            if share >= 0.5 and (n.cut == WEAK or id(n) in holds) or whole:
                n.cut = OPEN
    if any(n.readers and n.cut == FIRM for n in nodes):
        _scored(nodes, _blocks(root, FIRM), readers=True)
        if root.all < 1:  # no paragraph lies outside of what is named after readers, so the name is the page's
            _scored(nodes, _blocks(root, ALWAYS), readers=True)
            for n in nodes:
                if n.readers and n.cut == FIRM and n.all >= MAIN_SHARE * root.all and n.blocks >= MAIN_BLOCKS:
                    n.cut = OPEN


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines."""
    if not page:
        return ""
    root, nodes = parse(page)
    _spare(nodes, root)
    blocks = _blocks(root, WEAK)
    touched = _scored(nodes, blocks, readers=True)

    def score(n: Node) -> float:
        bonus = 5 if n.tag == "article" else 3 if n.tag == "main" or GOOD_NAMES.search(n.names) else 0
        return (n.points + bonus) * (1 - min(1.0, n.linked / max(n.chars, 1)))

    if not touched:
        return ""
    best = max((n for n in nodes if id(n) in touched), key=lambda n: (score(n), -n.depth))
    enclosing, up = {}, best
    while up:
        if up.tag in ("article", "main"):
            enclosing[up.tag] = up
        up = up.parent
    best = enclosing.get("article") or enclosing.get("main") or best
    top, kept, before = score(best), {id(best)}, True
    for other in best.parent.inside if best.parent else ():
        if other is best:
            before = False
        elif isinstance(other, Node) and not other.cut:
            dense = other.linked / max(other.chars, 1)
            near = id(other) in touched and score(other) >= max(10.0, 0.2 * top) and other.tag not in ("ul", "ol")
            plain = other.tag == "p" and best.tag != "article" and dense < 0.25
            opens = before and best.tag not in ("article", "main") and dense < 0.25 and (other.tag in HEADINGS or any(map(LEADS.search, other.names.split())))
            if near or plain or opens:
                kept.add(id(other))
    for n in nodes:  # what lies in a kept element is kept
        if n.parent and id(n.parent) in kept:
            kept.add(id(n))
    return "\n".join(text for owner, text, _ in blocks if id(owner) in kept)


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the column ``text``: the main text of the whole of ``html``; a column of that name is replaced."""
    base.small_batches(pages.sparkSession)
    pages = pages.drop(*[c for c in pages.columns if c.lower() == text.lower()])
    position = pages.columns.index(html)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)

    def run(batches):
        for batch in batches:
            found = pa.array([main_text(x) for x in batch.column(position).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, text])

    return pages.mapInArrow(run, f"{schema}, `{text}` string")

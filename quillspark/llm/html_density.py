"""HTML extraction by composite text density.

A page becomes a tree of its elements.  Each node has C characters of text, T tags, CL characters and
TL tags of links beneath it (T, CL, TL and C - CL count as 1 at least), and with the body's CB and CLB
the density

    D = C/T * log_b(x),  x = C/CL * T/TL,  b = ln(C/(C - CL) * CL + CLB/CB * C + e)

with log_b(x) = ln(max(x, 1) + e - 1) / max(ln(b + e - 1), 1), so that both logarithms are 1 at least;
without text it is 0.  (CL of a node without links is 0 in b.)  A node's density sum adds the densities
of its children; each run of its own text counts as a child without tags and links.  The threshold is
the least density on the path from the subtree with the largest sum to the body.  From
the body down, the content is the subtree with the largest sum (of equal ones the outermost, then the first)
beneath each node that reaches the threshold; what lies within content is not looked at again.  No name
of an element raises or picks a subtree.  Densities cannot tell short parts of an article, so that two
kinds of text beside chosen subtrees and the nodes above them are kept too: headings with nothing but
headings between them and what is kept next, and running text, that is paragraphs and what
ends like a sentence or has eight words, with fewer characters in links than outside of them.

Menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts, styles and
other elements without running text have no text.  They are told by element, role and class or id: by
whole names ("comments", "cookie-notice", "comment-list"), and names of which only a part tells
("related-posts") or beside which another tells of content ("site-content page-widgets") if the node
does not hold most of the page's text; names with "with", "has", "no" and "without" tell nothing.  If
whole names would leave less than a twentieth of a page's text, they too tell only of nodes that do not
hold most of it.  A header within an <article> or <main> is part of it.
Character references are decoded; within a block white space becomes one space; blocks are trimmed
and joined by one newline in page order, empty ones left out.  Nothing else is dropped or cut.

Null and empty pages, and those without text, give the empty text.  Broken mark-up never fails: what
is open at the end is closed there, and closing tags without opening ones are ignored.  Each row gives
one row, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

import html as html_
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices, pick

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|$)|</?[a-zA-Z][^>]*(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|aria-hidden|hidden|style)(?![\w-])\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without running text of the article.
OUT = frozenset("head nav header footer aside form script style noscript template svg canvas object embed iframe button select textarea input menu dialog audio video map title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert advertisement adverts advertising adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside "
    "notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "disqus reply replies respond commentlist widget widgets toolbar masthead pagination pager skip hidden header".split()
)
#: Parts of names beside WORDS that leave them whole names, and those that tell of what is elsewhere.
NEUTRAL = frozenset("list area section container wrapper wrap box block item items inner outer left right top bottom site page global links link bar widget unit slot".split())
ELSEWHERE = frozenset("with has no without".split())
#: Parts of names that tell of content.
CONTENT = frozenset("content article main post entry story text body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: How sentences end, before quotes and brackets that close.
SENTENCE = re.compile(r"[.!?…。！？][\s\"'”’»)\]]*$")
#: What a new element closes: p by blocks, and items, cells and rows by their like.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option", "optgroup", "legend", "summary", "figcaption"}
SPACE = re.compile(r"\s+")
SENTENCE_WORDS = 8


class Node:
    __slots__ = ("name", "up", "items", "out", "doubt", "chars", "named", "tags", "link_chars", "link_tags", "density", "total", "peak")

    def __init__(self, name: str, up: Node | None, out: bool, doubt: bool = False, named: bool = False) -> None:
        self.name, self.up, self.out, self.doubt, self.named = name, up, out, doubt, named
        self.items: list[Node | str] = []


def tells(names: str, header: bool) -> int:
    """2 if a class or id tells that an element is out, 1 if a part of a name does, else 0; header: whether headers are."""
    best, most = 0, 2
    for name in names.split():
        parts = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if p]
        most = 1 if CONTENT & set(parts) else most
        found = [p in WORDS and (header or p != "header") for p in parts]
        if any(found) and not ELSEWHERE & set(parts):
            best = max(best, 2 if all(f or p in NEUTRAL for f, p in zip(found, parts, strict=True)) else 1)
    return min(best, most)


def is_out(name: str, attributes: str, header: bool = True) -> tuple[bool, bool, bool]:
    """Whether an element is out, whether it is if it does not hold most of the text, and whether only its name has it out."""
    if name in OUT and (header or name != "header"):
        return True, False, False
    doubt = named = False
    for key, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), value.strip("\"'")
        low = value.lower()
        if key == "hidden" or key == "aria-hidden" and low == "true" or key == "role" and low in ROLES:
            return True, False, False
        if key == "style" and re.search(r"display\s*:\s*none", low):
            return True, False, False
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            told = tells(value, header)
            named |= told == 2
            doubt |= told == 1
    return named, doubt and not named, named


def tree(page: str) -> Node:
    """The page's elements; text of raw elements is dropped."""
    root = Node("#root", None, False)
    now, at, n = root, 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            now.items.append(page[at:])
            break
        if m.start() > at:
            now.items.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            x = now
            while x is not root and x.name != name:
                if x.name in ("table", "td", "th") and name not in ("table", "body", "html", "tr", "tbody", "thead", "tfoot") and name not in BLOCKS:
                    x = root
                    break
                x = x.up
            if x is not root:
                now = x.up
            continue
        if name in ENDS_P or name == "p":
            x = now
            while x is not root and x.name != "p" and x.name not in BLOCKS:
                x = x.up
            if x.name == "p":
                now = x.up
        if name in CLOSES:
            like, bounds = CLOSES[name]
            x, last = now, None
            while x is not root and x.name not in bounds:
                if x.name in like:
                    last = x
                x = x.up
            if last is not None:
                now = last.up
        x = now
        while x is not root and x.name not in ("article", "main"):
            x = x.up
        node = Node(name, now, *is_out(name, m[3], x is root))
        now.items.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|$)", re.I).search(page, at)
            node.out, node.named = True, False
            at = end.end() if end else n
        elif name not in VOID and not m[3].rstrip().endswith("/") or name in ("p", "div") and m[3].rstrip().endswith("/"):
            now = node
    settle(root)
    return root


def settle(root: Node) -> None:
    """Nodes in doubt are out unless they hold most of the text; so are those out by name if next to nothing would be left."""
    nodes = in_order(root, True)
    if not any(x.doubt or x.named for x in nodes):
        return

    def count(named: bool) -> int:
        """Characters of the root and of each node, with or without what is out by name."""
        for x in reversed(nodes):
            x.chars = sum(n_chars(c) if isinstance(c, str) else c.chars if not c.out or named and c.named else 0 for c in x.items)
        return root.chars

    left, whole = count(False), count(True)
    if 20 * left < whole:
        for x in nodes:
            x.doubt, x.out = x.doubt or x.named, x.out and not x.named
    else:
        count(False)
    for x in nodes:
        x.out = x.out or x.doubt and 2 * x.chars <= root.chars


def in_order(root: Node, named: bool = False) -> list[Node]:
    """Nodes that are not out (named: or out by name alone), parents first, without recursion."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(c for c in reversed(x.items) if isinstance(c, Node) and (not c.out or named and c.named))
    return out


def n_chars(s: str) -> int:
    return len(SPACE.sub("", html_.unescape(s)))


def measure(nodes: list[Node]) -> None:
    """Densities and density sums of nodes, parents first."""
    for x in reversed(nodes):
        kids = [c for c in x.items if isinstance(c, Node) and not c.out]
        x.chars = sum(n_chars(c) for c in x.items if isinstance(c, str)) + sum(c.chars for c in kids)
        x.tags = len(kids) + sum(c.tags for c in kids)
        own = x.name == "a"
        x.link_chars = x.chars if own else sum(c.link_chars for c in kids)
        x.link_tags = sum(c.link_tags + (c.name == "a") for c in kids)
    top = next((x for x in nodes if x.name == "body"), nodes[0])
    share = top.link_chars / top.chars if top.chars else 0.0
    for x in nodes:
        x.density = density(x.chars, x.tags, x.link_chars, x.link_tags, share)
    for x in nodes:
        x.total = sum(density(n_chars(c), 0, 0, 0, share) if isinstance(c, str) else 0.0 if c.out else c.density for c in x.items)


def density(c: int, t: int, cl: int, tl: int, share: float) -> float:
    """The composite density of c characters, t tags, cl characters and tl tags of links; share: the body's CLB / CB."""
    if not c:
        return 0.0
    t = max(t, 1)
    base = math.log(c / max(c - cl, 1) * cl + share * c + math.e)
    x = c / max(cl, 1) * t / max(tl, 1)
    return c / t * math.log(max(x, 1.0) + math.e - 1) / max(math.log(base + math.e - 1), 1.0)


def content(root: Node) -> list[Node]:
    """The subtrees of the content, in page order; none lies in another."""
    nodes = in_order(root)
    measure(nodes)
    top = next((x for x in nodes if x.name == "body"), root)
    inside = [x for x in in_order(top) if x.chars]
    if not inside:
        return []
    for x in reversed(inside):  # the first of equals: the outermost
        x.peak = max([x, *(c.peak for c in x.items if isinstance(c, Node) and not c.out and c.chars)], key=lambda y: y.total)

    def path(x: Node) -> list[Node]:
        """The nodes from the largest sum beneath x up to x."""
        out = [x.peak]
        while out[-1] is not x:
            out.append(out[-1].up)
        return out

    threshold = min(p.density for p in path(top))
    kept, chosen, stack = [], set(), [top]
    while stack:
        x = stack.pop()
        if id(x) not in chosen and x.density >= threshold:
            chosen.add(id(next((p for p in path(x) if p.name in BLOCKS), x.peak)))
        if id(x) in chosen:
            kept.append(x)
        else:
            stack.extend(c for c in reversed(x.items) if isinstance(c, Node) and not c.out and c.chars)
    return kept


def heads(x: Node) -> bool:
    """Whether a node is a heading, a header, or all of its text lies in headings."""
    stack: list[Node | str] = [x]
    while stack:
        y = stack.pop()
        if isinstance(y, str):
            if y.strip():
                return False
        elif not y.out and y.name not in HEADINGS and y.name != "header":
            stack.extend(y.items)
    return True


def runs_on(text: str) -> bool:
    """Whether a text is running text: it ends like a sentence, or has as many words as one."""
    return SENTENCE.search(text) is not None or len(text.split()) >= SENTENCE_WORDS


def with_beside(root: Node, kept: list[Node]) -> list[Node]:
    """kept, and what is kept beside it: headings before it and running text, in page order."""
    own, above = {id(x) for x in kept}, set()
    for x in kept:
        x = x.up
        while x is not None and id(x) not in above:
            above.add(id(x))
            x = x.up
    out: list[Node] = []
    waiting: list[Node] = []

    def parts(x: Node) -> list[Node]:
        """Blocks of a node, and the text between them as nodes of their own."""
        found: list[Node] = []
        run: list[Node | str] = []
        for c in [*x.items, None]:
            inline = isinstance(c, str) or c is not None and not c.out and c.name not in BLOCKS and id(c) not in own and id(c) not in above
            if inline:
                run.append(c)
                continue
            if run:
                between = Node("div", x, False)
                between.items, run = run, []
                between.chars = sum(n_chars(y) if isinstance(y, str) else y.chars for y in between.items)
                between.link_chars = sum(0 if isinstance(y, str) else y.link_chars for y in between.items)
                found.append(between)
            if c is not None and not c.out:
                found.append(c)
        return found

    stack = [root] if kept else []
    while stack:
        x = stack.pop()
        if id(x) in above:
            stack.extend(reversed(parts(x)))
        elif id(x) not in own and x.chars and heads(x):
            waiting.append(x)
        elif id(x) in own or x.chars and 2 * x.link_chars < x.chars and (x.name == "p" or runs_on("".join(blocks(x)[-1:]))):
            out += [*waiting, x]
            waiting = []
        elif x.chars:
            waiting = []
    return out


def blocks(node: Node) -> list[str]:
    """Texts of the blocks beneath a node, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", html_.unescape("".join(run))).strip()
        if text:
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.out or x is node:
            if x.name in BLOCKS:
                flush()
                stack.append(None)
            elif x.name in ("br", "wbr"):
                run.append(" " * (x.name == "br"))
            stack.extend(reversed(x.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The page's main text."""
    if not page:
        return ""
    root = tree(page)
    return "\n".join(b for node in with_beside(root, content(root)) for b in blocks(node))


def html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points)."""
    d = pick(pages, "page_id", "url", "html")

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    return in_slices(d, f"page_id {d.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint", run, rows=64)

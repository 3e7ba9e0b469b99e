"""Main text of web pages by composite text density.

Each block node gets its characters per tag, adjusted for links: with C characters, T tags, LC and LT of them in links, and the
body's share of link characters, the density is ``C/T * log_base(C/LC * T/LT)`` with ``base = ln(C/(C-LC) * LC + LC_b/C_b * C + e)``.
A node's density sum adds up its children's densities.  The least density on the path from the node of the greatest sum up to
the body is the threshold: below every node that reaches it, the node of the greatest sum is content, and the article is the
smallest subtree that holds all content, or the article or main element around it, with the headings and low-link text beside it.  Menus, adverts and the like are cut out by tag
before; forms and parts with such a name are, unless they hold nearly all text.
"""
from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCKS = frozenset("""address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
NO_TEXT = frozenset("aside button canvas dialog footer head iframe menu nav noscript object select svg template".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KEPT = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that name a part which is not the article.
NOT_ARTICLE = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation
breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup
share sharing social related recommended recommendations comment comments commentlist disqus respond replies widget toolbar login search copyright
contentinfo complementary""".split())
#: Words that say how or where such a part is built; they may stand beside the words above, but mark nothing alone.
BESIDE = frozenset("""area bar block bottom box button buttons col container content form global holder icons inner item items left link links list
main module outer page panel post posts right row section site sticky thread top unit wrap wrapper""".split())
#: Start tags that end an open paragraph or an open element of their own kind.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^"'>]|"[^"]*+"|'[^']*+')*+)>""")
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "marked")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.items: list = []
        self.marked = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0


def not_article(tag: str, open_tags: Counter) -> bool:
    """Whether the tag alone says that a part has no article text."""
    return tag not in KEPT and (tag in NO_TEXT or tag == "header" and not open_tags["article"] and not open_tags["main"])


def named(name: str) -> bool:
    """Whether one whole name (a class, an id, a role) is that of another part: all its words must say so, so that
    ``share-buttons`` does, and ``share-price`` and ``related-work`` don't."""
    words = WORD.findall(name)
    return not NOT_ARTICLE.isdisjoint(words) and all(w in NOT_ARTICLE or w in BESIDE for w in words)


def suspect(tag: str, attributes: str) -> bool:
    """Whether a part is a form or named like something else.  Headings are not: their ids are made of their own words."""
    if tag in KEPT or tag in VOID or tag in HEADINGS:
        return False
    return tag == "form" or "=" in attributes and any(named(x) for m in NAMES.finditer(attributes) for x in "".join(m.groups("")).lower().split())


def cut_suspects(root: Node) -> None:
    """Drops suspect parts.  A name does not outdo the page's own marks: a part that holds the article, the main element or the
    headline stays, and so do all if nothing else has text.  A form stays if it has more text than the rest of the page."""
    order, todo, own, heads = [], [root], {}, set()
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(k for k in n.items if isinstance(k, Node) and not k.dropped)
    if not any(n.marked for n in order):
        return
    for n in reversed(order):
        own[id(n)] = own.get(id(n), 0) + n.chars - n.link_chars
        if n.tag in ("article", "main", "h1"):
            heads.add(id(n))
        if n.parent is not None:
            own[id(n.parent)] = own.get(id(n.parent), 0) + own[id(n)]
            if id(n) in heads:
                heads.add(id(n.parent))
    whole = own[id(root)]
    cut = [n for n in order if n.marked and (2 * own[id(n)] <= whole if n.tag == "form" else id(n) not in heads)]
    inside = {id(n) for n in cut}
    gone = 0
    for n in cut:
        up = n.parent
        while up is not None and id(up) not in inside:
            up = up.parent
        gone += own[id(n)] if up is None else 0
    if gone < whole or not whole:
        for n in cut:
            n.dropped = True


def parse(page: str) -> Node:
    """The tree of block nodes and dropped parts; inline tags are only counted."""
    root = Node("html", None, False)
    stack, at, link = [root], 0, False
    open_tags: Counter = Counter()  # so that no end tag looks for what is not open

    def text(raw: str) -> None:
        top = stack[-1]
        if not top.dropped and raw:
            s = html.unescape(raw)
            n = len("".join(s.split()))
            top.items.append(s)
            top.chars += n
            if link:
                top.link_chars += n

    def close(depth: int) -> None:
        for n in stack[depth:]:
            open_tags[n.tag] -= 1
        del stack[depth:]

    while True:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        nxt = page[lt + 1:lt + 2]
        if page.startswith("<!--", lt):
            text(page[at:lt])
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if nxt in ("!", "?") and nxt:
            text(page[at:lt])
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        if not (nxt.isalpha() and nxt.isascii()) and nxt != "/":
            text(page[at:lt + 1])
            at = lt + 1
            continue
        m = TAG.match(page, lt)
        text(page[at:lt])
        if m is None:  # an open quote, or "</" without a name: up to the next ">", or the page ends inside the tag
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = False
            if open_tags[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        if tag in BLOCKS:
                            link = False
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = len(page) if end is None else end.end()
            continue
        if tag == "body":
            close(1)
        if tag in BLOCKS:
            link = False
            if tag not in ("html", "body"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in BLOCKS:
                        break
            closes = CLOSES.get(tag)
            if closes and any(open_tags[c] for c in closes):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closes:
                        close(i)
                        break
                    if stack[i].tag in LIMITS[tag]:
                        break
        top = stack[-1]
        drop = top.dropped or not_article(tag, open_tags)
        mark = not drop and suspect(tag, m[3])
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            top.tags += 1
            if tag in ("br", "hr", "wbr") and not top.dropped:
                top.items.append("\n" if tag == "hr" else " " if tag == "br" else "")
            continue
        if tag == "html":
            continue
        if tag in BLOCKS or mark or drop and not top.dropped or drop and tag in NO_TEXT:
            node = Node(tag, top, drop)
            node.marked = mark
            if not drop:
                top.items.append(node)
            else:
                top.items.append(" ") if tag not in BLOCKS else top.items.append(Node("", top, True))
            stack.append(node)
            open_tags[tag] += 1
            continue
        top.tags += 1
        if tag == "a":
            link = True
            top.link_tags += 1
    cut_suspects(root)
    return root


def measured(root: Node) -> list[Node]:
    """Nodes in page order, with subtree counts."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(c for c in reversed(n.items) if isinstance(c, Node) and not c.dropped)
    for n in reversed(order):
        n.tags += 1
        if n.parent is not None:
            for k in ("chars", "tags", "link_chars", "link_tags"):
                setattr(n.parent, k, getattr(n.parent, k) + getattr(n, k))
    return order


def article(root: Node) -> Node | None:
    order = measured(root)
    if not root.chars:
        return None
    share = root.link_chars / root.chars
    for n in order:
        c, t, lc, lt = n.chars, n.tags, n.link_chars, n.link_tags
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        inside = c / max(lc, 1) * t / max(lt, 1)
        n.density = c / t * math.log(max(inside, 1.0)) / math.log(base) if c and base > 1 else (c / t * math.log(max(inside, 1.0)) if c else 0.0)
    for n in reversed(order):
        kids = [k for k in n.items if isinstance(k, Node) and not k.dropped]
        n.total = sum(k.density for k in kids) if kids else n.density
        n.best = max([n, *(k.best for k in kids)], key=lambda k: k.total)  # ties: the outer node
    top = root.best
    threshold, n = top.density, top
    while n is not None:
        threshold, n = min(threshold, n.density), n.parent
    content = {id(n.best): n.best for n in order if n.density >= threshold and n.chars}
    # the least common ancestor of all content
    nodes = list(content.values())
    path = []
    n = nodes[0]
    while n is not None:
        path.append(n)
        n = n.parent
    depth = {id(n): i for i, n in enumerate(path)}
    reach = 0
    for n in nodes[1:]:
        while id(n) not in depth:
            n = n.parent
        reach = max(reach, depth[id(n)])
    found = path[reach]
    # an article or main is taken whole
    return next((n for n in path[reach:] if n.tag in ("article", "main")), found)


def beside(found: Node, share: float = 0.3) -> list[Node]:
    """``found`` and, level by level up to a main element or the root, what belongs to it, in page order.

    Those are headings before it and, unless it is an article, all blocks and loose texts with few links.
    """
    out, n, whole = [found], found, found.tag == "article"
    while n.parent is not None and n.tag != "main":
        kids = [k for k in n.parent.items if isinstance(k, Node) and not k.dropped]
        own, own_links = (getattr(n.parent, c) - sum(getattr(k, c) for k in kids) for c in ("chars", "link_chars"))
        before, after, passed = [], [], False
        for k in n.parent.items:
            side = after if passed else before
            if k is n:
                passed = True
            elif isinstance(k, str):
                if not whole and own_links <= share * own:
                    if not side or side[-1].tag != "#":
                        side.append(Node("#", None, False))
                    side[-1].items.append(k)
            elif k.dropped or k.link_chars > share * k.chars:
                if side and side[-1].tag == "#":
                    side.append(Node("", None, True))
            elif not whole or not passed and k.tag in HEADINGS:
                side.append(k)
        out, n = [*before, *out, *after], n.parent
    return out


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below ``node`` in page order, white space turned into single blanks."""
    out, run, todo = [], [], [iter(node.items)]

    def flush() -> None:
        s = " ".join("".join(run).split())
        run.clear()
        if s:
            out.append(s)
    while todo:
        item = next(todo[-1], None)
        if item is None:
            todo.pop()
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif item.dropped and item.marked and item.tag not in BLOCKS:
            run.append(" ")
        else:
            flush()
            if not item.dropped:
                todo.append(iter(item.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    found = article(parse(page)) if page else None
    return "\n".join(line for n in beside(found) if not n.dropped for line in blocks(n)) if found is not None else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: ``key``, ``url``, text, n_chars.

    A null or empty page, or one without text outside of cut parts, has an empty text.  Rows and keys may repeat or be null; an
    empty table gives no rows.  Pages cut off inside a tag or comment end there.
    """
    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            for at in range(0, rb.num_rows, 500):
                part = rb.slice(at, 500)
                texts = [main_text(p) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    return pages.select(key, url, F.col(page)).mapInArrow(work, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint")

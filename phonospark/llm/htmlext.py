"""Main text of web pages by tree scoring.

The page is read into a tree of elements and text blocks. Every block passes points, for its length and
its commas, to its ancestors, in full to the nearest container and halved with every level above;
a container's score is discounted by the share of its text that lies in links. Where an article or main
element that isn't mostly links holds the best container, that is the article, with siblings of its kind and
paragraphs, headings, quotes, lists and tables beside it that aren't mostly links. Elsewhere the best container's parents are taken while few of their words are links, and
whatever stands beside the path to it stays, of any tag, unless it is mostly links. Page furniture
(menus, headers of the page, footers, adverts, forms, scripts, reader comments) never scores; forms do where they hold
most of the page's text.

Every step is linear in the page: open elements are counted by block and by list, so that an end tag
looks up only what it closes, and sums go up and choices go down the tree in one pass each.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonospark.llm.common import rows_of

# What HTML says of its elements.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "menu", "table"}
FURNITURE = {"nav", "footer", "aside", "form", "button", "select", "fieldset", "menu", "dialog", "head", "svg", "canvas", "object", "audio", "video", "label", "input"}
#: Names of classes, ids and roles that mark furniture, as whole words of the name.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split())
MARKS_BUT_FORMS = MARKS - {"form"}
FORMS = {"form", "fieldset"}
MARK_STARTS = ("advert", "comment", "sidebar", "sponsor")
#: Beside these words a mark says how a page is laid out, as in `has-sidebar`.
LAYOUT = frozenset("has with no without layout wrapper page".split())
#: From this share of its text on, links make an element a list of links.
LINKED = 0.3
#: What stands in the text of an article, beside its container as well.
CONTENT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "ul", "ol", "dl", "pre", "figure", "table"}
CONTAINERS = {"article", "main", "section", "div", "body", "td", "blockquote", "center"}

ITEMS = frozenset(CLOSED_BY) | {x for own in CLOSED_BY.values() for x in own}
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
TAG_END = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
FORM = re.compile(r"<(?:form|fieldset)\b|[\"'\s=_-]form[\"'\s>_-]", re.I)
NAMES = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Node:
    """An element; `holder` is its nearest block, `scope` its nearest list or table, `marked` its nearest article."""

    __slots__ = ("tag", "up", "bad", "link", "holder", "scope", "marked", "inline", "items", "chars", "linked", "points", "passed", "keep")

    def __init__(self, tag: str, up: Node | None, bad: bool = False, link: bool = False) -> None:
        self.tag, self.up, self.bad, self.link = tag, up, bad, link
        self.holder = self if up is None or tag in BLOCK else up.holder
        self.scope = self if up is None or tag in SCOPE else up.scope
        self.marked = self if tag in ("article", "main") else up and up.marked
        self.inline: Counter = Counter()  # open elements in this block that aren't blocks
        self.items: Counter = Counter()  # open items of this list
        self.chars = self.linked = 0
        self.points = self.passed = 0.0
        self.keep = False

    @property
    def container(self) -> bool:
        return self.up is None or self.tag in CONTAINERS

    @property
    def value(self) -> float:
        return self.points * (1 - self.linked / max(1, self.chars)) * (1.5 if self.tag in ("article", "main") else 1)


@dataclass
class Block:
    node: Node
    text: list[str] = field(default_factory=list)
    linked: int = 0


def is_furniture(tag: str, attributes: str, up: Node, forms: bool) -> bool:
    """forms: whether forms are furniture."""
    if tag in FURNITURE and (forms or tag not in FORMS) or tag == "header" and up.marked is None:
        return True
    if not attributes:
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            for word in map(NAMES.findall, value.split()):
                if LAYOUT.isdisjoint(word) and (not (MARKS if forms else MARKS_BUT_FORMS).isdisjoint(word) or any(w.startswith(MARK_STARTS) for w in word)):
                    return True
    return False


class Ends:
    """Where tags end, quotes being closed; where they never are, at the next sign of an end.

    The first tag whose quotes stay open has all quotes and ends of the page paired, from the back, so
    that no later one is looked for again.
    """

    def __init__(self, page: str) -> None:
        self.page, self.at = page, None

    def __call__(self, pos: int) -> int:
        if self.at is None and (m := TAG_END.match(self.page, pos)):
            return m.end() - 1
        if self.at is None:
            self._pair()
        k = bisect_left(self.at, pos)
        end = self.end[k] if k < len(self.at) else -1
        return end if end >= 0 else self.page.find(">", pos)

    def _pair(self) -> None:
        page = self.page
        self.at = [m.start() for m in re.finditer("[\"'>]", page)]
        self.end, following = [-1] * (len(self.at) + 1), {}
        for k in range(len(self.at) - 1, -1, -1):
            c = page[self.at[k]]
            if c == ">":
                self.end[k] = self.at[k]
            else:
                self.end[k] = self.end[following[c] + 1] if c in following else -1
                following[c] = k


def self_closed(attributes: str) -> bool:
    """A slash at the end, unless it belongs to a value without quotes."""
    if not attributes.endswith("/"):
        return False
    name, sign, value = attributes.split()[-1].partition("=")
    return not sign or not value or value[0] in "\"'" or value == "/"


def parse(page: str, forms: bool = True) -> tuple[list[Node], list[Block]]:
    """The elements, parents first, and the text blocks in page order; blocks of furniture, of forms if these are, are left out."""
    root = Node("root", None)
    at, nodes, blocks, open_block = root, [root], [], None
    opened: Counter = Counter()
    pos, size, last_end, tag_end = 0, len(page), page.rfind(">"), Ends(page)

    def close(found) -> None:
        """Leave elements up to the first that is `found`, and that one."""
        nonlocal at
        while at is not root:
            x, at = at, at.up
            opened[x.tag] -= 1
            if x.tag not in BLOCK:
                at.holder.inline[x.tag] -= 1
            if x.tag in ITEMS:
                at.scope.items[x.tag] -= 1
            if found(x):
                return

    def say(text: str) -> None:
        nonlocal open_block
        if at.bad or not text:
            return
        if open_block is None:
            open_block = Block(at.holder)
            blocks.append(open_block)
        open_block.text.append(text)
        if at.link:
            open_block.linked += len(SPACE.sub(" ", text).strip())

    start = 0
    while pos < size:
        i = page.find("<", pos)
        comment = i >= 0 and page.startswith("<!--", i)
        if i < 0 or i > last_end and not comment:  # no tag can end any more
            c = page.find("<!--", i) if i >= 0 else -1
            say(html.unescape(page[start : c if c >= 0 else size]))
            break
        name = NAME.match(page, i + 1)
        if not comment and name is None and page[i + 1 : i + 2] not in ("!", "?"):
            pos = i + 1  # a sign of less
            continue
        if i > start:
            say(html.unescape(page[start:i]))
        if name is None:
            m = COMMENT_END.search(page, i + 4) if comment else None
            pos = start = (m.end() if m else size) if comment else page.find(">", i) + 1
            continue
        end = tag_end(name.end())
        attributes, tag = page[name.end() : end], name[2].lower()
        pos = start = end + 1
        if name[1]:  # an end tag
            if tag in BLOCK:
                open_block = None
            if opened[tag] > 0 if tag in BLOCK else at.holder.inline[tag] > 0:
                close(lambda x: x.tag == tag)  # noqa: B023
            continue
        if tag in BLOCK:
            open_block = None
        if tag in RAW:
            m = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            pos = start = m.end() if m else size
            continue
        if tag in VOID:
            if tag == "br":
                say(" ")
            continue
        if tag in CLOSES_P and at.holder.tag == "p":
            close(lambda x: x.tag == "p")
        if tag in CLOSED_BY and any(at.scope.items[x] > 0 for x in CLOSED_BY[tag]):
            close(lambda x: x.tag in CLOSED_BY[tag])  # noqa: B023
        bad = at.bad or is_furniture(tag, attributes, at, forms)
        if tag not in BLOCK and self_closed(attributes):
            continue
        opened[tag] += 1
        if tag not in BLOCK:
            at.holder.inline[tag] += 1
        if tag in ITEMS:
            at.scope.items[tag] += 1
        at = Node(tag, at, bad, at.link or tag == "a")
        nodes.append(at)
    return nodes, blocks


def scored(nodes: list[Node], held: list[tuple[Block, str]]) -> Node:
    """Sums and scores of all elements; the best container."""
    for b, t in held:
        b.node.chars += len(t)
        b.node.linked += min(b.linked, len(t))
        b.node.passed += 1 + min(len(t) / 100, 3) + t.count(",")
    best = nodes[0]
    for x in reversed(nodes):  # children first
        if x.container:
            x.points, x.passed = x.passed, x.passed / 2
        if x.up is not None:
            x.up.chars += x.chars
            x.up.linked += x.linked
            x.up.passed += x.passed
    return max((x for x in nodes if x.container and x.chars), key=lambda x: x.value, default=best)


def climbed(best: Node) -> set[Node]:
    """The best container and its parents, while the parent holds little else or few links, and one more."""
    top, path = best, {best}
    while top.up is not None:
        up = top.up
        path.add(up)
        if 2 * top.chars < up.chars and up.linked >= LINKED * up.chars:
            break
        top = up
    return path


def told(page: str, forms: bool) -> tuple[list[Node], list[tuple[Block, str]], int]:
    """The elements, the blocks with their texts, and how many characters of these aren't links."""
    nodes, blocks = parse(page, forms)
    held = [(b, t) for b in blocks if (t := SPACE.sub(" ", "".join(b.text)).strip())]
    return nodes, held, sum(max(0, len(t) - b.linked) for b, t in held)


def extract(page: str | None) -> str:
    """The article's blocks in page order, one to a line; empty where the page has none."""
    if not page:
        return ""
    nodes, held, size = told(page, True)
    if FORM.search(page):
        # forms that hold most of a page's text are no furniture: some pages are one form
        more = told(page, False)
        if more[2] > 2 * size:
            nodes, held, size = more
    if not held:
        return ""
    best = scored(nodes, held)
    few_links = lambda x: x.linked < LINKED * x.chars
    article = best.marked if best.marked is not None and few_links(best.marked) else None
    path = set() if article else climbed(best)
    for x in nodes:  # parents first
        if article:
            beside = x is not article and x.up is article.up and x.up is not None
            same = beside and x.tag == article.tag and few_links(x)
            content = beside and x.tag in CONTENT and x.linked < 0.25 * x.chars
            x.keep = x is article or same or content or x.up is not None and x.up.keep
        else:
            x.keep = x is best or x not in path and (x.up.keep if x.up and (x.up not in path or x.up is best) else few_links(x))
    out = []
    for b, t in held:
        if b.node.keep or not article and b.node in path and b.linked < LINKED * len(t):
            out.append(t)
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Null or empty html, or a page of furniture alone, gives an empty text of no characters. Rows are read
    each on their own, so repeated rows and null ids need no rule; of containers that score alike the first
    in the page is taken. Pages are read whole, in time linear in their length. No rows give no rows.
    Columns of pages other than these three aren't read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (pages,) in rows_of(batches, "html"):
            texts = [extract(p) for p in pages]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")

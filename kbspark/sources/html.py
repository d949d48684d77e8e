"""The main text of a web page as Markdown.

Tags are read one by one into a tree of elements. Each block of text counts by its length, less what stands
in links. The main part is the page's largest `article` or `main`; without one, the deepest element
that still holds most of the counted text. Menus, headers, notes and lists of links go.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements without content, without text to read, of page furniture, and that start a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript svg template iframe head title object canvas select textarea".split())
FURNITURE = set("nav header footer aside form button dialog menu".split())
BLOCKS = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An element that may stay open, and the ones that end it.
ENDED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Where a search for the open element stops.
SCOPES = {"table", "ul", "ol", "dl", "article", "main", "section", "body", "html"}
#: Share of the counted text that the main part holds; share of a block in links from which it is a menu; letters of a menu's entries on average.
MOST, LINKED, ENTRY = 0.6, 0.6, 60


@dataclass
class Element:
    tag: str
    attrs: dict
    parent: Element | None
    children: list = field(default_factory=list)  # elements and texts
    text: int = 0  # characters, and those in links, of all below
    linked: int = 0

    def chain(self):
        at = self
        while at is not None:
            yield at
            at = at.parent


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("html", {}, None)

    def handle_starttag(self, tag, attrs):
        for e in self.at.chain():
            if tag in ENDED_BY.get(e.tag, ()):
                self.at = e.parent
                break
            if e.tag in SCOPES or e.tag in BLOCKS and tag not in BLOCKS:
                break
        made = Element(tag, dict(attrs), self.at)
        self.at.children.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag, attrs):
        # only void elements end themselves; others are opened
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for e in self.at.chain():
            if e.tag == tag and e.parent is not None:
                self.at = e.parent
                return
            if e.tag in ("table", "body") and tag not in SCOPES:  # an end tag doesn't reach out of these
                return

    def handle_data(self, data):
        self.at.children.append(data)

    def unknown_decl(self, data):
        pass


def read_tree(html: str) -> Element:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


def _order(root: Element) -> list[Element]:
    """All elements, parents before children."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        out.append(e)
        todo += [c for c in reversed(e.children) if isinstance(c, Element)]
    return out


def _measure(elements: list[Element]) -> None:
    for e in reversed(elements):
        own = sum(len(" ".join(c.split())) for c in e.children if isinstance(c, str))
        below = [c for c in e.children if isinstance(c, Element) and c.tag not in HIDDEN]
        e.text = own + sum(c.text for c in below)
        e.linked = e.text if e.tag == "a" else sum(c.linked for c in below)


def _is_menu(e: Element) -> bool:
    """A block of links with little else."""
    if e.tag not in BLOCKS or not e.text or e.linked < LINKED * e.text:
        return False
    entries = sum(1 for c in _order(e) if c.tag == "a")
    return entries > 1 and e.text / entries <= ENTRY


def _goes(e: Element) -> bool:
    return e.tag in HIDDEN or e.tag in FURNITURE or "hidden" in e.attrs or e.attrs.get("aria-hidden") == "true" or _is_menu(e)


def main_part(root: Element) -> Element:
    elements = _order(root)
    _measure(elements)
    dropped, counted = set(), {}
    for e in elements:
        if id(e.parent) in dropped or _goes(e):
            dropped.add(id(e))
    for e in reversed(elements):
        own = 0 if e.tag == "a" else sum(len(" ".join(c.split())) for c in e.children if isinstance(c, str))
        counted[id(e)] = 0 if id(e) in dropped else own + sum(counted[id(c)] for c in e.children if isinstance(c, Element))
    marked = [e for e in elements if e.tag in ("article", "main") and counted[id(e)] and not any(p.tag in ("article", "main") for p in e.parent.chain())]
    if marked:
        return max(marked, key=lambda e: counted[id(e)])
    at = root
    while True:
        below = [c for c in at.children if isinstance(c, Element) and c.tag in BLOCKS]
        best = max(below, key=lambda c: counted[id(c)], default=None)
        # a paragraph is no part of its own: several of them make the text
        if best is None or counted[id(best)] < MOST * counted[id(root)] or best.tag in ("p", "ul", "ol", "table", "pre", "blockquote", "dl"):
            return at
        at = best


def _markdown(main: Element) -> str:
    """The text of an element and all below; walks a stack, as pages may be nested deeply."""
    out: list[str] = []

    def close(mark):
        return ("close", mark)

    todo: list = [main]
    lists: list[list] = []  # of open lists: ordered, items so far
    pre = 0
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item if pre else re.sub(r"[ \t\r\n\f\v]+", " ", item))
            continue
        if isinstance(item, tuple):
            kind = item[1]
            if kind == "list":
                lists.pop()
                out.append("\n")
            elif kind == "pre":
                pre -= 1
                out.append("\n```\n\n")
            elif callable(kind):
                kind()
            else:
                out.append(kind)
            continue
        e = item
        if e is not main and (e.tag == "img" or _goes(e)):
            out.append(" ")
            continue
        end: list = []
        if re.fullmatch("h[1-6]", e.tag):
            out.append("\n\n" + "#" * int(e.tag[1]) + " ")
            end = [close("\n\n")]
        elif e.tag in ("ul", "ol"):
            lists.append([e.tag == "ol", 0])
            out.append("\n" if len(lists) > 1 else "\n\n")
            end = [close("list")]
        elif e.tag == "li":
            state = lists[-1] if lists else [False, 0]
            state[1] += 1
            out.append("\n" + "\u0001" * (len(lists) - 1) + (f"{state[1]}. " if state[0] else "- "))
        elif e.tag == "br":
            out.append("\n")
        elif e.tag == "hr":
            out.append("\n\n---\n\n")
        elif e.tag == "pre":
            pre += 1
            out.append("\n\n```\n")
            end = [close("pre")]
        elif e.tag == "a" and e.attrs.get("href"):
            start = len(out)

            def link(start=start, href=e.attrs["href"]):
                text = " ".join("".join(out[start:]).split())
                del out[start:]
                if text:
                    out.append(f"[{text}]({href})")

            end = [close(link)]
        elif e.tag in ("td", "th"):
            out.append(" | " if any(isinstance(c, Element) and c.tag in ("td", "th") for c in e.parent.children[: _place(e)]) else "")
        elif e.tag == "tr":
            out.append("\n")
        elif e.tag in ("p", "blockquote", "dl", "table", "figure"):
            out.append("\n\n")
            end = [close("\n\n")]
        elif e.tag in BLOCKS:
            out.append("\n")
            end = [close("\n")]
        todo += [*reversed(end), *reversed(e.children)]
    lines, fenced = [], False
    for line in "".join(out).split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        lines.append(line.rstrip() if fenced else re.sub(r" +", " ", line.replace("\xa0", " ")).strip().replace("\u0001", "  "))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _place(e: Element) -> int:
    return next(i for i, c in enumerate(e.parent.children) if c is e)


def html_markdown(html: str | None) -> str:
    """The main part of a page as Markdown: headings, list items, tables and links stay, images and page furniture go. Null gives an empty text."""
    return _markdown(main_part(read_tree(html or "")))

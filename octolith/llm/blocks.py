"""Leaf blocks of web pages: text between block-level tags, with the elements that hold it."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; it is never text of the page. Without an end tag they reach to the end of the page.
RAW = frozenset("script style iframe textarea title noembed noframes xmp".split())
#: Elements whose content is left out too; without an end tag only the start tag is.
LEFT_OUT = frozenset("template svg math object select".split())
#: An element that an opening tag ends if it is still open, up to the container named.
IMPLIED_END = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}

_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</([a-zA-Z][^\s/>]*+)[^>]*+>?|<[!?/][^>]*+>?|<[a-zA-Z][^>]*+>?""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|data-label|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(frozen=True)
class Element:
    tag: str
    names: tuple[str, ...] = ()
    label: str = ""
    marks: tuple[str, ...] = ()


class Node:
    """An open element with the one that holds it. What its ancestors have is passed on, so no path is ever copied or searched.

    ``new`` are the marks that no ancestor has; ``block`` is the node or its nearest ancestor that
    is no inline element.
    """

    __slots__ = ("element", "parent", "number", "depth", "new", "block", "label", "linked", "articles", "named")

    def __init__(self, element: Element, parent: Node | None, number: int, new: tuple[str, ...]):
        self.element, self.parent, self.number, self.new = element, parent, number, new
        self.depth = parent.depth + 1 if parent else 1
        self.block = self if element.tag not in INLINE else parent.block if parent else None
        self.label = element.label or (parent.label if parent else "")
        self.linked = element.tag == "a" or bool(parent and parent.linked)
        self.articles = (element.tag == "article") + (parent.articles if parent else 0)
        self.named = bool(element.names) or bool(parent and parent.named)


@dataclass
class Block:
    path: Node | None
    parent: int
    text: str
    link_chars: int
    label: str


_SEEN: dict[tuple[str, str], Element] = {}


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


def _element(tag: str, attributes: str) -> Element:
    found = _SEEN.get((tag, attributes))
    if found is None:
        names, label = [], ""
        for key, value in _ATTRIBUTE.findall(attributes):
            value, key = html.unescape(value.strip("\"'")), key.lower()
            if key == "data-label":
                label = value
            elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                names.append("=hidden")
            elif key != "style":
                names += [("role-" if key == "role" else "") + n for n in _NAME.findall(_CAMEL.sub(" ", value).lower())]
        names = tuple(dict.fromkeys(names))
        marks = [f"t:{tag}", *(f"c:{n}" for n in names), *(f"s:{n[:4]}" for n in names if len(n) > 4)]
        found = Element(tag, names, label, tuple(dict.fromkeys(marks)))
        if len(_SEEN) > 50_000:
            _SEEN.clear()
        _SEEN[tag, attributes] = found
    return found


class _Open:
    """The open elements, where those of each tag are, and how many carry each mark."""

    def __init__(self) -> None:
        self.stack: list[Node] = []
        self.at: dict[str, list[int]] = {}
        self.marks: dict[str, int] = {}
        self.opened = 0

    def push(self, element: Element) -> None:
        self.opened += 1
        new = []
        for m in element.marks:
            n = self.marks.get(m, 0)
            if not n:
                new.append(m)
            self.marks[m] = n + 1
        self.at.setdefault(element.tag, []).append(len(self.stack))
        self.stack.append(Node(element, self.stack[-1] if self.stack else None, self.opened, tuple(new)))

    def pop(self) -> Element:
        element = self.stack.pop().element
        self.at[element.tag].pop()
        for m in element.marks:
            self.marks[m] -= 1
        return element

    def last(self, tags) -> int:
        """The place of the innermost of these elements, -1 if none is open."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=-1)

    def first_above(self, tags, place: int) -> int:
        """The place of the outermost of these elements inside that place, -1 if there is none."""
        found = [places[k] for t in tags if (places := self.at.get(t)) and (k := bisect_right(places, place)) < len(places)]
        return min(found, default=-1)


def parse(page: str) -> list[Block]:
    """The non-empty leaf blocks in page order. White space inside a block is one space; character references are decoded.

    A slash before the end of a tag closes ``svg`` and ``math`` only, as in HTML. The work grows
    with the length of the page, however deep it is nested.
    """
    open_ = _Open()
    stack = open_.stack
    out: list[Block] = []
    text: list[str] = []
    never_closed: set[str] = set()
    links = 0

    def flush():
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                path = stack[-1].block if stack else None
                out.append(Block(path, path.parent.number if path and path.parent else 0, joined, links, stack[-1].label if stack else ""))
            text.clear()
        links = 0

    def close(first: int):
        if stack[-1].block and stack[-1].block.depth > first:
            flush()
        while len(stack) > first:
            open_.pop()

    position, end = 0, len(page)
    while position < end:
        m = _TOKEN.search(page, position)
        stop = m.start() if m else end
        if stop > position:
            piece = html.unescape(page[position:stop])
            text.append(piece)
            if stack and stack[-1].linked:
                links += len(piece.strip())
        if not m:
            break
        position = m.end()
        tag = m[1]
        if tag:
            tag, attributes = tag.lower(), m[2]
            if tag not in INLINE:
                flush()
                if stack and stack[-1].block and stack[-1].block.element.tag == "p":  # a paragraph ends where a block begins
                    close(stack[-1].block.depth - 1)
                if tag in IMPLIED_END:
                    ends, within = IMPLIED_END[tag]
                    if (first := open_.first_above(ends.split(), open_.last(within))) >= 0:
                        close(first)
            if tag in VOID:
                continue
            if tag in RAW or tag in LEFT_OUT:
                if tag in ("svg", "math") and attributes.endswith("/"):
                    continue
                closing = None if tag in never_closed else _closing(tag).search(page, position)
                if closing:
                    position = closing.end()
                elif tag in RAW:
                    position = end
                else:
                    never_closed.add(tag)
                continue
            open_.push(_element(tag, attributes))
        elif m[3]:
            tag = m[3].lower()
            if tag not in INLINE:
                flush()
            if open_.at.get(tag):
                close(open_.at[tag][-1])
    flush()
    return out

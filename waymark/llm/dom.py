"""Web pages as sequences of leaf blocks: the text between block-level boundaries, with the elements around it."""

import re
from html import unescape
from typing import NamedTuple

#: Element names of the HTML standard, by how they bound text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    (
        "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
        "math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext "
        "mtr munder munderover semantics annotation svg g text tspan canvas object"
    ).split()
)
UNSEEN = frozenset("script style template head".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CLOSES = {
    "li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}),
    "td": ("td th", {"tr"}), "th": ("td th", {"tr"}), "option": ("option", {"select"}),
}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|[^>]*>?)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$|[\"'][^>]*+>?)", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/>]|$)", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_WORDS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]  # names of the elements around the text, outermost first
    names: frozenset[str]  # words of their classes, ids and roles
    linked: int  # characters inside links
    hidden: bool = False  # whether an element around it is marked as hidden, as pages do until a script shows it


class Element(NamedTuple):
    tag: str
    names: frozenset[str]
    unseen: bool
    hidden: bool


def _marks(attributes: str) -> tuple[frozenset[str], bool]:
    names, hidden = set(), False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), unescape(value.strip("\"'"))
        if key == "style":
            hidden |= bool(_HIDDEN.search(value))
        elif key == "hidden" or key == "aria-hidden":
            hidden |= key == "hidden" or value == "true"
        else:
            names.update(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    return frozenset(names), hidden


def blocks(html: str) -> list[Block]:
    """Leaf blocks in page order, white space as single spaces, character references decoded.

    Only scripts, styles, templates and the head are left out. Text of hidden elements
    and of those that stand in for others (noscript, iframe) is text like any other.
    """
    out: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    linked = links = unseen = 0
    at = 0

    def close_block():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tags = tuple(e.tag for e in stack if e.tag not in INLINE)
                out.append(Block(text, tags, frozenset().union(*(e.names for e in stack)), linked, any(e.hidden for e in stack)))
            parts, linked = [], 0

    def cut_to(depth):
        nonlocal links, unseen
        links -= sum(e.tag == "a" for e in stack[depth:])
        unseen -= sum(e.unseen for e in stack[depth:])
        del stack[depth:]

    while at < len(html):
        match = _TOKEN.search(html, at)
        start = match.start() if match else len(html)
        if start > at and not unseen:
            piece = unescape(html[at:start])
            parts.append(piece)
            if links:
                linked += len(piece)
        if not match:
            break
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
            if tag not in INLINE:
                close_block()
            if depth is not None and (tag not in INLINE or all(e.tag in INLINE for e in stack[depth:])):
                cut_to(depth)
            continue
        inline = tag in INLINE
        if not inline:
            close_block()
            if tag in CLOSES:
                ends, stop = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in stop:
                        break
                    if stack[i].tag in ends.split():
                        cut_to(i)
            elif tag not in VOID:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == "p":
                        cut_to(i)
                        break
                    if stack[i].tag not in INLINE:
                        break
            if tag == "body" or tag in ("header", "nav", "main", "article", "div", "p") and stack and stack[-1].tag == "head":
                cut_to(next((i for i, e in enumerate(stack) if e.tag == "head"), len(stack)))
        if tag in VOID or match[3].endswith("/") and tag not in RAW:
            continue
        names, hidden = _marks(match[3]) if match[3].strip() else (frozenset(), False)
        stack.append(Element(tag, names, tag in UNSEEN, hidden))
        unseen += stack[-1].unseen
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            stop = end.start() if end else len(html)
            if not unseen:
                parts.append(unescape(html[at:stop]) if tag in ("textarea", "title") else html[at:stop])
            at = stop
        links += tag == "a"
    close_block()
    return out

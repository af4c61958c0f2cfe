"""Cut a page into the leaf blocks of its DOM: runs of text between block-level tags."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Fixed values of the HTML standard: elements without an end tag, and elements whose text is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title"  # what follows is no markup up to the end tag, or to the end of the page
HIDDEN = frozenset("noscript template svg iframe object canvas audio video".split())
#: Elements that flow with the text around them; all others start and end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup "
    "time tt u var wbr label".split()
)
#: A start tag ends open elements of these kinds above the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot select div section article body".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_MARK = re.compile(r"\bdata-main\b", re.IGNORECASE)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|\baria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_HIDES = re.compile(r"(?:^|\s)hidden(?=[\s/=]|$)", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str  # references decoded, white space as single spaces
    path: tuple[str, ...]  # open elements, outermost first, as "tag" or "tag.name.name"; "!unseen" is the name of one that is not shown
    linked: int  # characters inside links
    main: bool  # inside an element with a data-main attribute: the label of training pages


def _names(attrs: str) -> list[str]:
    found = []
    for quoted in _NAMES.findall(attrs):
        found += _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(quoted)).lower())
    if _UNSEEN.search(attrs) or _HIDES.search(_QUOTED.sub("", attrs)):
        found.append("!unseen")
    return found


def _shown(page: str) -> Iterator[tuple[re.Match, int]]:
    """The tokens outside hidden elements, each with the place where the page goes on.

    A hidden element reaches from its start tag to its own end tag. A start tag that has none, as a
    self-closed one, hides nothing: what follows it is as likely the page's text.
    """
    tokens = list(_TOKEN.finditer(page))
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for i, token in enumerate(tokens):
        tag = (token["tag"] or token["tag2"] or "").lower()
        if tag not in HIDDEN:
            continue
        if not (token["end"] or token["end2"]):
            if not token[0].endswith("/>"):
                opened.setdefault(tag, []).append(i)
        elif opened.get(tag):
            ends[opened[tag].pop()] = i
    i = 0
    while i < len(tokens):
        last = ends.get(i, i)
        yield tokens[i], tokens[last].end()
        i = last + 1


def blocks(page: str) -> list[Block]:
    """The blocks with any text, in page order. Broken markup is taken as far as it goes."""
    out: list[Block] = []
    stack: list[str] = []
    path: list[str] = []
    marks = links = 0
    text: list[str] = []
    linked = 0
    marked: list[bool] = []

    def close() -> None:
        nonlocal linked
        if text:
            clean = " ".join(html.unescape("".join(text)).split())
            if clean:
                kept = tuple(p for p, tag in zip(path, stack, strict=True) if tag not in INLINE)
                out.append(Block(clean, kept, linked, marks > 0))
        text.clear()
        linked = 0

    def pop(size: int) -> None:
        nonlocal marks, links
        while len(stack) > size:
            tag = stack.pop()
            path.pop()
            marks -= marked.pop()
            links -= tag == "a"

    def end(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] == tag or (tag in HEADINGS and stack[i] in HEADINGS):
                pop(i)
                return

    place = 0
    for token, stop in _shown(page):
        if token.start() > place:
            piece = page[place : token.start()]
            text.append(piece)
            linked += len(piece) if links else 0
        place = stop
        tag = token["tag"] or token["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in HIDDEN:
            continue
        inline = tag in INLINE
        if not inline:
            close()
        if token["end"] or token["end2"]:
            end(tag)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID:
            continue
        if not inline:
            if "p" in stack:
                end("p")  # a paragraph holds no blocks
            for kind in ENDS.get(tag, ()):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i] == kind:
                        pop(i)
                        break
                    if stack[i] in CONTAINERS:
                        break
        attrs = token["attrs"] or ""
        stack.append(tag)
        path.append(".".join([tag, *_names(attrs)]) if "=" in attrs or "hidden" in attrs.lower() else tag)
        main = "data-main" in attrs and bool(_MARK.search(attrs))
        marked.append(main)
        marks += main
        links += tag == "a"
    rest = page[place:]
    if "<" in rest and re.search(r"<[a-zA-Z/!?][^>]*\Z", rest):
        rest = rest[: rest.rindex("<")]
    text.append(rest)
    close()
    return out



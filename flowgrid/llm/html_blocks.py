"""Leaf blocks of a page: texts between block boundaries, with their ancestors' tags and names."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# Elements that don't break a block, that have no content, that hold no page text,
# and that a new element of the same group closes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = frozenset("audio button canvas datalist noscript object select svg template video".split())
ENDS_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
GROUP = {"dd": {"dt", "dd"}, "dt": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"thead", "tbody", "tfoot"}, "tbody": {"thead", "tbody", "tfoot"}, "tfoot": {"thead", "tbody", "tfoot"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Block:
    text: str
    #: Signatures of the ancestors that aren't inline, outermost first: tag and names.
    path: tuple[str, ...]
    link_chars: int


def _signature(tag: str, attributes: str) -> str:
    names = sorted({p.lower() for m in _NAMES.findall(attributes) for p in _PART.findall(m)}) if attributes and "=" in attributes else []
    return " ".join([tag, *names])


def leaf_blocks(page: str) -> tuple[str, list[Block]]:
    """The page's title and its leaf blocks in page order.

    Inline elements and <br> don't end a block. Scripts, styles, comments, controls and whatever
    isn't shown give none. Unclosed and stray tags are read as browsers do in the common cases.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()  # of the stack's tags, so that only what is open is looked for
    parts: list[str] = []
    links = unseen = in_link = 0
    where: tuple[str, ...] | None = None
    title = ""

    def flush() -> None:
        nonlocal links, where
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, where or (), links))
            parts.clear()
        links, where = 0, None

    def pop(n: int) -> None:
        nonlocal unseen, in_link
        for tag, _ in stack[n:]:
            unseen -= tag in UNSEEN
            in_link -= tag == "a"
            opened[tag] -= 1
        del stack[n:]

    def say(text: str) -> None:
        nonlocal links, where
        if text and not unseen:
            if where is None and not text.isspace():
                where = tuple(s for t, s in stack if t not in INLINE and t not in ("html", "body"))
            parts.append(text)
            if in_link:
                links += len(text)

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        closing, attributes = m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            if tag in INLINE:
                for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                    if stack[k][0] == tag:
                        in_link -= tag == "a"
                        opened[tag] -= 1
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE and tag == "a":
                        continue
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    pop(k)
                    break
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
            if tag == "title" and not title:
                title = " ".join(html.unescape(page[at : end.start() if end else len(page)]).split())
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            flush()
            if opened["p"]:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"))
            if tag in ENDS_ITSELF and any(opened[t] for t in GROUP.get(tag, {tag})):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ENDS_ITSELF[tag]:
                        break
                    if stack[k][0] in GROUP.get(tag, {tag}):
                        pop(k)
                        break
        if attributes.endswith("/") and tag not in INLINE and tag in UNSEEN:
            continue
        stack.append((tag, _signature(tag, attributes) if tag not in INLINE else tag))
        opened[tag] += 1
        unseen += tag in UNSEEN
        in_link += tag == "a"
    say(page[at:])
    flush()
    return title, blocks

"""Blocks of text of an HTML page, with the path of elements that each stands in."""

from __future__ import annotations

import re
from html import unescape
from zlib import crc32

# Fixed values of the HTML standard.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HIDDEN = frozenset("iframe math noembed noframes noscript object script style svg template title".split())
#: Start tags that close an open element of the named kinds, up to the nearest of the bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TAG = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|$)""", re.S
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I) for name in HIDDEN}

#: Slots of hashed path tokens.
PATH_SLOTS = 1_024


def slot(token: str, slots: int = PATH_SLOTS) -> int:
    return crc32(token.encode("utf-8", "surrogatepass")) % slots


class Paths:
    """Element paths as nodes of a tree, each with the slots of its tokens; shared by many pages."""

    MOST = 50_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.down: dict[tuple[int, str, str], int] = {}
        self.tokens: list[tuple[int, ...]] = [()]
        self.leaf: list[int] = [slot("leaf:")]

    def child(self, node: int, tag: str, attributes: str) -> int:
        key = (node, tag, attributes)
        found = self.down.get(key)
        if found is None:
            names = [w.lower() for m in _NAMES.finditer(attributes) for w in _WORD.findall(m[1] or m[2] or m[3] or "")]
            found = self.down[key] = len(self.tokens)
            self.tokens.append((*self.tokens[node], slot(tag), *(slot(f".{n}") for n in dict.fromkeys(names))))
            self.leaf.append(slot(f"leaf:{tag}"))
        return found


def blocks(html: str, paths: Paths) -> list[tuple[str, int, float]]:
    """(text, path node, share of linked characters) of every block with text, in page order.

    Elements that are not inline part blocks; a line break is white space. Character
    references are decoded, white space (in Unicode's sense) becomes one space. Comments,
    scripts, styles, the title and other content that a page does not show are left out.
    End tags that nothing opened are passed over, and elements left open end with the page.
    """
    out: list[tuple[str, int, float]] = []
    stack: list[tuple[str, int]] = [("", 0)]
    pieces: list[str] = []
    linked, total, in_link = 0, 0, False
    at = 0

    def flush() -> None:
        nonlocal linked, total
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, stack[-1][1], linked / max(1, total)))
            pieces.clear()
        linked = total = 0

    def close(kinds: set[str], bounds: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in kinds:
                del stack[i:]
                return
            if stack[i][0] in bounds:
                return

    while True:
        m = _TAG.search(html, at)
        end = m.start() if m else len(html)
        if end > at:
            piece = html[at:end]
            if "&" in piece:
                piece = unescape(piece)
            pieces.append(piece)
            total += len(piece)
            linked += len(piece) if in_link else 0
        if not m:
            flush()
            return out
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = False
            elif tag not in INLINE and tag not in VOID:
                opened = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                # A stray end of a paragraph still parts the text, others are passed over.
                if opened or tag == "p":
                    flush()
                    in_link = False
                if opened:
                    del stack[opened:]
        elif tag in HIDDEN:
            # Only the page's own title element and the like; an element that closes itself holds nothing.
            if not m[3].endswith("/"):
                stop = _ENDS[tag].search(html, at)
                at = stop.end() if stop else len(html)
        elif tag in INLINE:
            if tag == "a":
                in_link = True
        elif tag == "br":
            pieces.append(" ")
        else:
            flush()
            in_link = False
            if tag in CLOSES:
                close(*CLOSES[tag])
            elif stack[-1][0] == "p":
                stack.pop()
            if tag not in VOID:
                stack.append((tag, paths.child(stack[-1][1], tag, m[3])))

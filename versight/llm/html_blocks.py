"""HTML as a sequence of text blocks with their tag paths.

A small tokenizer: comments, declarations and the contents of raw elements (scripts,
styles, templates) are markup; elements of ``BLOCK`` begin and end blocks, others don't; a
paragraph or list item that isn't closed ends where the next block begins. Character
references are decoded, white space inside a block (line breaks included) becomes one
blank, and blocks without text are left out. Nothing is dropped for its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>", re.DOTALL)
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
BLOCK = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
RAW = frozenset("script style template noscript iframe svg textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end when one of the others begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Path:
    """A tag path as its last step and a pointer to the rest, so that paths share what they have in common.

    A step is the tag and, after dots, its class, id and role words. ``sums`` is free for
    what a reader adds up along the path.
    """

    __slots__ = ("parent", "step", "sums")

    def __init__(self, parent: Path | None, step: str):
        self.parent, self.step, self.sums = parent, step, None

    def steps(self) -> Iterator[str]:
        """From the last step to the first."""
        at: Path | None = self
        while at is not None:
            yield at.step
            at = at.parent


def blocks_of(html: str | None) -> list[tuple[Path | None, str, int]]:
    """(tag path, text, characters inside links) of each block with text, in page order.

    Memory grows with the page, however deep its elements are nested. The path is None
    outside all elements.
    """
    out: list[tuple[Path | None, str, int]] = []
    stack: list[tuple[str, Path]] = []
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0
    inside = 0  # open links

    def end_block():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((stack[-1][1] if stack else None, text, min(linked, len(text))))
            parts.clear()
            linked = 0

    def close(at: int):
        nonlocal inside
        inside -= sum(t == "a" for t, _ in stack[at:])
        open_.subtract(t for t, _ in stack[at:])
        del stack[at:]

    at = 0
    if not html:
        return out
    while True:
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            parts.append(text)
            if inside:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            end_block()
        elif tag == "br":
            parts.append(" ")
            continue
        if m[1]:
            if not open_[tag]:
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in ENDS.get(tag, ()):
                    close(i)
                    break
                if stack[i][0] in BLOCK and stack[i][0] != "li":
                    break
        names = " ".join(a or b or c for a, b, c in NAMES.findall(m[3])) if "=" in m[3] else ""
        stack.append((tag, Path(stack[-1][1] if stack else None, ".".join([tag, *names.lower().split()]) if names else tag)))
        open_[tag] += 1
        inside += tag == "a"
    end_block()
    return out

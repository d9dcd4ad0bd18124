"""Leaf blocks of a page: runs of text between block-level tags, with what surrounds them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Fixed values of the HTML language, each in alphabetical order.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Controls and what a browser replaces; their text is no part of the page.
HIDDEN_TAGS = frozenset("datalist head iframe noscript option select svg template".split())
#: An open tag of the key ends where a tag of the value begins.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "p": BLOCK_TAGS - {"body", "caption", "html", "legend", "optgroup", "option", "select", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"},
}
#: An end tag does not reach beyond these.
SCOPES = frozenset({"table", "td", "th", "html"})

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(script|style|textarea|title|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\b[^>]*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</[^a-zA-Z][^>]*>|</>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|[^<]+|<(?:/?[a-zA-Z][^<>]*\Z)?",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/]|$))", re.I)
NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    names: tuple[str, ...]
    link_chars: int
    label: int | None = None


def leaf_blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order, character references decoded and white space run together.

    ``names`` are the words of the class, id and role attributes of all
    ancestors, and ``hidden`` where one of them isn't shown: that is for the
    model to weigh, not dropped here. A ``data-label`` attribute (labelled pages)
    gives ``label``. Comments, scripts, styles and controls give no blocks.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool, int | None]] = []
    parts: list[str] = []
    hidden = links = link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, tuple(s[0] for s in stack), tuple(n for s in stack for n in s[1]), min(link_chars, len(text)), next((s[3] for s in reversed(stack) if s[3] is not None), None)))
            parts.clear()
        link_chars = 0

    def pop(to: int) -> None:
        nonlocal hidden, links
        while len(stack) > to:
            tag, _, hides, _ = stack.pop()
            hidden -= hides
            links -= tag == "a"

    for m in TOKEN.finditer(page):
        tag = m[3]
        if tag is None:
            token = m[0]
            if m[1] or (token[0] == "<" and len(token) > 1) or hidden:
                continue
            text = html.unescape(token)
            parts.append(text)
            if links:
                link_chars += len(text.strip())
            continue
        tag = tag.lower()
        block = tag in BLOCK_TAGS
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if block or any(s[0] in BLOCK_TAGS for s in stack[k:]):
                        flush()
                    pop(k)
                    break
                if stack[k][0] in SCOPES and block:
                    break
            else:
                if block:
                    flush()
            continue
        if block:
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if tag in CLOSES.get(stack[k][0], ()):
                    pop(k)
                    break
                if stack[k][0] in BLOCK_TAGS and stack[k][0] not in ("p",):
                    break
        elif tag == "br":
            parts.append("\n")
        if tag in VOID_TAGS:
            continue
        names, hides, label, attributes = (), tag in HIDDEN_TAGS, None, m[4]
        if attributes:
            found = []
            for name, *values in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values).lower()
                if name in ("class", "id", "role"):
                    found += NAME.findall(value)
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    found.append("hidden")
            names = tuple(found)
            if "data-label" in attributes:
                label = int(attributes.split('data-label="')[1][0])
        stack.append((tag, names, hides, label))
        hidden += hides
        links += tag == "a"
    flush()
    return blocks

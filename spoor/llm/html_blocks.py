"""Leaf blocks of an HTML page: the text between block-level tags, with the path of the elements around it.

Character references are decoded, white space (also the no-break space) becomes one space, and blocks without text are left out. Comments,
declarations, scripts, styles and other elements whose content is no text have none. Unclosed and stray tags are read as a
browser would as far as the path needs it: a paragraph, item or cell ends where the next begins, an end tag closes what
is open inside it, and one without a start is passed over.
"""

from __future__ import annotations

import html
import re
from zlib import crc32

#: Elements that begin and end a block (fixed names of HTML).
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style template iframe noframes noembed svg object canvas audio video".split())
#: Elements whose content is text alone, without tags.
PLAIN = frozenset(["title", "textarea"])
#: Elements whose inside a new paragraph or block does not end a paragraph around.
SCOPE = frozenset("button caption table td th".split())
#: Which open element a start tag ends, if no element of the second set is nearer.
ENDS = {
    **{t: ("p", SCOPE) for t in BLOCK - {"body", "html", "head", "option", "optgroup", "title", "button", "label"}},
    "li": ("li", frozenset(["ul", "ol", "menu", "dir"])),
    "dt": ("dd", frozenset(["dl"])),
    "dd": ("dt", frozenset(["dl"])),
    "tr": ("tr", frozenset(["table"])),
    "td": ("td", frozenset(["tr", "table"])),
    "th": ("td", frozenset(["tr", "table"])),
    "option": ("option", frozenset(["select"])),
}
#: What such a start tag ends beside the one above.
ALSO = {"li": "p", "dt": "dt", "dd": "dd", "td": "th", "th": "th"}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_PART = re.compile(r"[a-z]+")

#: Bins of the hashed path.
PATH_BINS = 1024


def _bin(token: str) -> int:
    return crc32(token.encode("utf-8", "replace")) % PATH_BINS


_plain: dict[tuple[str, str], tuple[int, ...]] = {}


def _tokens(tag: str, attrs: str) -> tuple[int, ...]:
    """Bins of an element's name and of the words in its class, id and role."""
    if not attrs:
        key = (tag, "")
    else:
        key = (tag, " ".join(sorted({w for m in _NAMED.finditer(attrs) for w in _PART.findall((m[1] or m[2] or m[3] or "").lower())})))
    found = _plain.get(key)
    if found is None:
        found = tuple(sorted({_bin(f"tag {tag}"), *(_bin(f"name {w}") for w in key[1].split())}))
        if len(_plain) < 100_000:
            _plain[key] = found
    return found


class _Frame:
    __slots__ = ("bins", "inner", "link", "tag")

    def __init__(self, tag: str, bins: tuple[int, ...], inner: tuple[int, ...], link: bool):
        self.tag, self.bins, self.inner, self.link = tag, bins, inner, link


def blocks(page: str | None) -> list[tuple[str, tuple[int, ...], float]]:
    """Text, distinct bins of the path, and share of link text of every block, in page order."""
    out: list[tuple[str, tuple[int, ...], float]] = []
    stack: list[_Frame] = [_Frame("", (), (), False)]
    open_: dict[str, int] = {}
    pieces: list[str] = []
    linked = 0

    def text(raw: str) -> None:
        nonlocal linked
        if "&" in raw:
            raw = html.unescape(raw)
        pieces.append(raw)
        if stack[-1].link:
            linked += len(raw)

    def cut() -> None:
        nonlocal linked
        if pieces:
            joined = " ".join("".join(pieces).split())
            if joined:
                # the innermost block element also counts by its place
                frame = next((f for f in reversed(stack) if f.tag in BLOCK), stack[0])
                out.append((joined, stack[-1].bins + frame.inner, min(1.0, linked / len(joined))))
            pieces.clear()
        linked = 0

    def push(tag: str, attrs: str) -> None:
        own = _tokens(tag, attrs)
        top = stack[-1]
        bins = top.bins if set(own) <= set(top.bins) else tuple(dict.fromkeys(top.bins + own))
        stack.append(_Frame(tag, bins, (_bin(f"own {tag}"),), top.link or tag == "a"))
        open_[tag] = open_.get(tag, 0) + 1

    def pop_to(tag: str, stop: frozenset[str] = frozenset(), inline: bool = False) -> None:
        """Closes the nearest open ``tag`` and what is open inside it; not across ``stop``, nor across a block for an inline one."""
        if not open_.get(tag):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                for f in stack[i:]:
                    open_[f.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in stop or (inline and stack[i].tag in BLOCK):
                return

    page = page or ""
    at, n, raw_until = 0, len(page), None
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if at == n and page[-1] != ">":  # the page ends within a tag
            break
        if m["end"]:
            if tag in BLOCK:
                cut()
                pop_to(tag)
            elif tag == "br":
                pieces.append(" ")
            elif tag not in VOID:
                pop_to(tag, inline=True)
            continue
        if tag in BLOCK:
            cut()
            ends = ENDS.get(tag)
            if ends:
                pop_to(ends[0], ends[1])
                if tag in ALSO:
                    pop_to(ALSO[tag], ends[1])
        attrs = m["attrs"]
        if tag == "br":
            pieces.append(" ")
        elif tag in RAW:
            if not attrs.endswith("/") or tag in ("script", "style"):
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else n
        elif tag not in VOID:
            push(tag, attrs)
            if tag in PLAIN:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                end = close.start() if close else n
                text(page[at:end])
                at = end
    cut()
    return out

"""Leaf blocks of a page: runs of text between the edges of block elements, with what stands above them.

A small forgiving reader: one pattern finds tags and comments, a stack holds the open elements, and
the implied ends of paragraphs, list items and table cells are honoured. With the marks that a model knows, its work is
linear in the page, however deep elements nest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container
from dataclasses import dataclass

#: Elements that end a block where they begin and end.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements without content, and those whose content is not text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noframes noembed iframe svg".split())
#: Of those, the ones that reach to the end of the page if they aren't closed; others are then taken as empty.
_TO_THE_END = frozenset(("script", "style"))
#: What an element that begins closes, and the elements beyond which it doesn't look.
CLOSES = {
    "li": (("li",), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (("dt", "dd"), frozenset(("dl",))),
    "dd": (("dt", "dd"), frozenset(("dl",))),
    "td": (("td", "th"), frozenset(("tr", "table"))),
    "th": (("td", "th"), frozenset(("tr", "table"))),
    "tr": (("tr",), frozenset(("table",))),
    "option": (("option",), frozenset(("select",))),
}
#: Elements that end an open paragraph where they begin.
_ENDS_P = BLOCK - frozenset("body button caption head html iframe label legend option optgroup select td textarea th title tr tbody thead tfoot".split())
_P_SCOPE = frozenset(("button", "td", "th", "caption", "table", "object", "html"))

#: Elements whose tags are marks; other inline ones only say how letters look.
_MARKED = BLOCK | {"a", "ins"}

_TAG = re.compile(
    r"""<!--(?:-?>|.*?--!?>|.*\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<more>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_PART = re.compile(r"[a-z]+", re.I)


#: Block elements that stand beside their like in a text; where one stands is told by what is around it.
_WITHIN = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol dl li dt dd blockquote pre hr center caption table tbody thead tfoot tr figure figcaption".split())


@dataclass(eq=False)
class Home:
    """An element that holds blocks: its number in page order, the element around it, the last number within it."""

    number: int
    around: Home | None
    last: int

    def within(self, other: Home) -> bool:
        return other.number <= self.number <= other.last


@dataclass
class Block:
    """White-space-trimmed text, how many of its characters are in links, its element, the marks of all above, and its home."""

    text: str
    linked: int
    tag: str
    marks: frozenset[str]
    home: Home


def _names(tag: str, attributes: str) -> list[str]:
    """``.word`` for each word of class, id and role; ``page.word`` where they speak of the whole page."""
    found = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))
    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", found)
    return [f"{'page' if tag in ('html', 'body') else ''}.{w.lower()}" for w in _PART.findall(spaced)]


class _Open:
    """The open elements; each level has the marks of all levels down to it, and its innermost block element."""

    def __init__(self, known: Container[str] | None):
        self.known = known
        self.tags: list[str] = []
        self.inner: list[str] = ["body"]
        self.marks: list[frozenset[str]] = [frozenset()]
        self.homes: list[Home] = [Home(0, None, 0)]
        self.last = 0
        self.count: dict[str, int] = {}

    def push(self, tag: str, names: list[str]) -> None:
        above = self.marks[-1]
        new = [m for m in ((f"<{tag}", *names) if tag in _MARKED else names) if m not in above and (self.known is None or m in self.known)]
        self.tags.append(tag)
        self.inner.append(tag if tag in BLOCK else self.inner[-1])
        self.marks.append(above.union(new) if new else above)
        if tag in BLOCK and tag not in _WITHIN:
            self.last += 1
            self.homes.append(Home(self.last, self.homes[-1], self.last))
        else:
            self.homes.append(self.homes[-1])
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop_to(self, at: int) -> None:
        for tag in self.tags[at:]:
            self.count[tag] -= 1
        for home in self.homes[at + 1 :]:
            if home is not self.homes[at]:
                home.last = self.last
        del self.tags[at:], self.marks[at + 1 :], self.inner[at + 1 :], self.homes[at + 1 :]

    def find(self, wanted: tuple[str, ...], scope: frozenset[str]) -> int:
        """Where the innermost wanted element stands that no element of the scope hides, or -1."""
        if not any(self.count.get(w) for w in wanted):
            return -1
        for i in range(len(self.tags) - 1, -1, -1):
            if self.tags[i] in wanted:
                return i
            if self.tags[i] in scope:
                return -1
        return -1

    def begin(self, tag: str) -> None:
        """Ends what an element that begins implies to have ended."""
        if tag in CLOSES:
            at = self.find(*CLOSES[tag])
            if at >= 0:
                self.pop_to(at)
        if tag in _ENDS_P:
            at = self.find(("p",), _P_SCOPE)
            if at >= 0:
                self.pop_to(at)

    def end(self, tag: str) -> None:
        at = self.find((tag,), frozenset() if tag in BLOCK else BLOCK)
        if at >= 0:
            self.pop_to(at)


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks of a page in order, those without text left out; of marks only the known ones, if given."""
    out: list[Block] = []
    above, parts, linked = _Open(known), [], 0
    nowhere = ("", frozenset(), above.homes[0])
    where: tuple[str, frozenset[str], Home] = nowhere

    def text(raw: str) -> None:
        nonlocal linked, where
        if not raw:
            return
        if not parts or not where[0]:
            where = (above.inner[-1], above.marks[-1], above.homes[-1]) if raw.strip() else nowhere
        parts.append(html.unescape(raw) if "&" in raw else raw)
        if above.count.get("a"):
            linked += len(parts[-1].strip())

    def close() -> None:
        nonlocal linked
        if parts:
            whole = " ".join("".join(parts).split())
            if whole:
                out.append(Block(whole, linked, where[0] or "body", where[1], where[2]))
            parts.clear()
            linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
        elif m["end"]:
            if name in BLOCK:
                close()
            above.end(name)
        elif name in RAW and not m["more"].endswith("/"):
            if name in BLOCK:
                close()
            after = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            at = after.end() if after else end if name in _TO_THE_END else at
        else:
            if name in BLOCK:
                close()
                above.begin(name)
            if name not in VOID:
                above.push(name, _names(name, m["more"]) if "=" in m["more"] else [])
    close()
    above.homes[0].last = above.last
    above.pop_to(0)
    return out

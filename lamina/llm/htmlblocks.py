"""Pages as sequences of leaf blocks: a tolerant tag reader.

A leaf block is the text between two boundaries of block-level elements (or line breaks), together with
the open elements around it. Character references are decoded, white space inside a block becomes one
space, blocks without text are left out.

The reader goes forward only and its time is linear in the page. A tag ends at the first > outside the quotes of
its attributes; once a tag is met that would not end, quotes are ignored from there on. What no > follows is
text. Contents of scripts and styles are skipped up to their end tag or the end of the page, as browsers do;
contents of other skipped elements only if their end tag is there. A foreign element that closes itself ends at
once. An end tag finds its element at any depth.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Contents are no text of the page; without an end tag the first two take all that follows, the others nothing.
SKIPPED = ("script", "style", "noscript", "template", "iframe", "svg", "noframes", "noembed")
SWALLOWING = frozenset(SKIPPED[:2])
#: Contents are text without tags.
PLAIN = ("title", "textarea")
#: An end tag of another element does not reach beyond these.
SCOPES = ("td", "th", "caption", "table")
TABULAR = frozenset("table tbody td tfoot th thead tr caption body html".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup "
    "option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: A start tag in the set closes an open element of that name, unless one of the barriers is nearer.
CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split()),
    "li": frozenset(["li"]),
    "dd": frozenset(["dd", "dt"]),
    "dt": frozenset(["dd", "dt"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
BARRIERS = {"p": frozenset(["button", "td", "th", "table", "body"]), "li": frozenset(["ul", "ol", "menu"]), "dd": frozenset(["dl"]), "dt": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "option": frozenset(["select"]), "head": frozenset()}
#: By start tag: what it closes.
_CLOSED_BY = {tag: tuple(name for name, tags in CLOSES.items() if tag in tags) for tag in frozenset().union(*CLOSES.values())}
#: Of deeper paths, blocks show so many outer and so many inner elements.
SHOWN = 100

#: A whole tag in which every quote is closed before the next <; no part can pass a <, so a failure costs little.
_TAG = re.compile(r"""<(/?)([a-z][^\s/><]*+)((?:[\s/]++[^\s"'<>=/]++(?:\s*+=\s*+(?:"[^"<]*+"|'[^'<]*+'|[^\s"'=<>]++))?)*+)[\s/]*+>""", re.IGNORECASE)
_NAME = re.compile(r"</?([a-z][^\s/>]*+)", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""[\s/]*+(=?[^\s/>=]*+)(?:\s*+=\s*+(?:(["'])|([^\s>"'][^\s>]*+)))?""")
_NAMED = re.compile(r"""(?<![^\s/"'])(?:class|id|role|itemprop|aria-label)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.IGNORECASE)
_NAMES = frozenset(["class", "id", "role", "itemprop", "aria-label"])
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in (*SKIPPED, *PLAIN)}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """A leaf block: its path, from the root, as tuples of tokens; its text; how many of its characters are linked."""

    path: tuple[tuple[str, ...], ...]
    text: str
    linked: int


def _words(values: list[str]) -> tuple[str, ...]:
    return tuple(x.lower() for value in values for x in _TOKEN.findall(value))


class _Reader:
    """Goes through a page; what is found to be missing once is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.at = page, 0
        self.last = page.rfind(">")  # no tag ends beyond
        self.quotes = True
        self.missing: set[str] = set()
        self.cache: dict[str, tuple[str, ...]] = {}

    def find_end(self, name: str) -> int:
        """Where the next end tag of the name is, or -1."""
        if name in self.missing:
            return -1
        if found := _ENDS[name].search(self.page, self.at):
            return found.start()
        self.missing.add(name)
        return -1

    def attributes(self, at: int) -> tuple[int, tuple[str, ...]] | None:
        """The end of the tag whose name ends at `at`, and the words of its telling attributes; None if it does not end."""
        page, values = self.page, []
        while at < len(page):
            if page[at] == ">":
                return at + 1, _words(values)
            found = _ATTRIBUTE.match(page, at)
            name, quote, value = found.groups()
            begin, at = at, found.end()
            if quote:
                if quote in self.missing or (end := page.find(quote, at)) < 0:
                    self.missing.add(quote)
                    return None
                value, at = page[at:end], end + 1
            if value and name.lower() in _NAMES:
                values.append(value)
            if at == begin:  # a sign that starts nothing
                at += 1
        return None

    def tag(self) -> tuple[bool, str, tuple[str, ...], bool] | None:
        """The tag at this place (whether it ends an element, its name, words, whether it closes itself), which is passed."""
        page = self.page
        if self.at > self.last:
            return None
        if found := _TAG.match(page, self.at):
            self.at = found.end()
            raw, (end, name, rest) = found[0], found.groups()
            if raw not in self.cache:
                self.cache[raw] = _words(["".join(x) for x in _NAMED.findall(rest)])
            return bool(end), name.lower(), self.cache[raw], raw[-2] == "/"
        if not (found := _NAME.match(page, self.at)):
            return None
        end, words = -1, ()
        if self.quotes:
            if whole := self.attributes(found.end()):
                end, words = whole
            else:
                self.quotes = False
        if end < 0:
            end = page.index(">", self.at) + 1
        name = found[1]
        closed, self.at = page[self.at + 1] == "/", end
        return closed, name.lower(), words, page[end - 2] == "/"


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    names: list[str] = []
    path: list[tuple[str, ...]] = []
    places: dict[str, list[int]] = {}  # of the open elements of each name
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    reader = _Reader(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                shown = tuple(path) if len(path) <= 2 * SHOWN else (*path[:SHOWN], *path[-SHOWN:])
                out.append(Block(shown, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        text = html.unescape(text) if "&" in text else text
        if parts or not text.isspace():
            parts.append(text)
            linked += len(text) if places.get("a") else 0

    def last(name: str) -> int:
        own = places.get(name)
        return own[-1] if own else -1

    def close(at: int) -> None:
        if any(x in BLOCKS for x in names[at:]):
            flush()
        for name in reversed(names[at:]):
            places[name].pop()
        del names[at:]
        del path[at:]

    while reader.at < len(page):
        begin = page.find("<", reader.at)
        if begin != reader.at:
            add(page[reader.at : begin if begin >= 0 else len(page)])
            if begin < 0:
                break
            reader.at = begin
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 2)
            reader.at = end + 3 if end >= 0 else len(page)
            continue
        if not (found := reader.tag()):
            if page.startswith(("<!", "<?", "</"), begin) and begin < reader.last:
                reader.at = page.index(">", begin) + 1
            else:
                add("<")
                reader.at = begin + 1
            continue
        end, tag, words, itself = found
        if end:
            at = last(tag)
            if at >= 0 and (tag in TABULAR or all(last(x) < at for x in SCOPES)):
                close(at)
            elif tag in BLOCKS:
                flush()
            continue
        for name in _CLOSED_BY.get(tag, ()):
            at = last(name)
            if at >= 0 and all(last(x) < at for x in BARRIERS[name]):
                close(at)
        if tag in BLOCKS:
            flush()
        if tag in VOID or itself and (tag in ("svg", "math") or places.get("math")):
            continue
        if tag in SKIPPED:
            if (stop := reader.find_end(tag)) >= 0:
                reader.at = stop
                reader.tag()
                continue
            if tag in SWALLOWING:
                break
        names.append(tag)
        path.append(("<" + tag, *words))
        places.setdefault(tag, []).append(len(names) - 1)
        if tag in PLAIN and (stop := reader.find_end(tag)) >= 0:
            add(page[reader.at : stop])
            reader.at = stop
    flush()
    return out

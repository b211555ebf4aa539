"""Pages as flat outlines, for the jobs that ask what stands inside what.

A page becomes two lists: its pieces of text, and its elements, each with the range of pieces that it
spans. Containment is then a comparison of ranges, and a question about a block is a grouping of
its pieces by the elements around them. Nothing here recurses, so unclosed tags cost nothing.
A page of plain markup is cut at its tags into lists (``Flat``). A page with an odd place is read by
``Outline``: plain markup by one pattern and the rest of the page by the standard library's parser,
which gives the same parts for plain markup at many times the cost.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements whose own text is not shown, elements that can carry a heading.
SILENT = {"script", "style", "noscript", "template", "form"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "strong", "span"}
# Fields of linked data that hold addresses, in the order they are read.
ADDRESS_FIELDS = ("url", "contentUrl", "image")
# Words in class names that tell what a piece of text says about a point.
ROLES = {"type": ("type", "tipo"), "name": ("name", "nome"), "distance": ("dist",)}

# An attribute as pages mostly write it, and a text with the tag, comment or doctype that ends it.
_ATTRIBUTE = r"""[ \t\n\r\f]++[a-zA-Z][-a-zA-Z0-9_:]*+(?:=(?:"[^"]*+"|'[^']*+'|[-a-zA-Z0-9_.:#%?&;/]++(?=[ \t\n\r\f>])))?"""
_PLAIN = re.compile(
    rf"([^<]*+)<(?:([a-zA-Z][a-zA-Z0-9]*+)((?:{_ATTRIBUTE})*)[ \t\n\r\f]*+(/?)>|/([a-zA-Z][-.a-zA-Z0-9:_]*+)[ \t\n\r\f]*+>|!--.*?--\s*>|!doctype[^>]*+>)",
    re.DOTALL | re.IGNORECASE | re.ASCII,
)
_PAIRS = re.compile(r"""([^\s=]+)(?:=("[^"]*"|'[^']*'|\S+))?""", re.ASCII)
# The same tags, but for the sign that begins them, and what is cut out of a page as a whole: comments, scripts and
# styles. One that does not end takes the rest of the page.
_TAG = re.compile(
    rf"(?:([a-zA-Z][a-zA-Z0-9]*+)((?:{_ATTRIBUTE})*)[ \t\n\r\f]*+(/?)|/([a-zA-Z][-.a-zA-Z0-9:_]*+)[ \t\n\r\f]*+|![dD][oO][cC][tT][yY][pP][eE][^>]*+)>",
)
_RAW_END = r"(?u:/\s*(?(1)script|style)\s*>)"
_WHOLE = re.compile(
    rf"<(?:!--(?:[^-]++|-(?!-\s*+>))*+--\s*+>|(?:(script)|style)((?:{_ATTRIBUTE})*)[ \t\n\r\f]*+>((?:[^<]++|<(?!{_RAW_END}))*+)<({_RAW_END}))|<(!--|(?:script|style)[\s/>]).*+",
    re.DOTALL | re.IGNORECASE | re.ASCII,
)
# Tags without attributes, as they were read before.
_BARE: dict[str, tuple[int, str]] = {}
_OPENS, _EMPTY, _ENDS, _NOTHING = range(4)
# What stands in these is no markup.
_RAW = {tag: re.compile(rf"</\s*{tag}\s*>", re.IGNORECASE) for tag in HTMLParser.CDATA_CONTENT_ELEMENTS}


def one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def folded(text: str | None) -> str:
    if (text or "").isascii():
        return one_line(text).casefold()
    plain = unicodedata.normalize("NFKD", text)
    return one_line("".join([c for c in plain if c < "\u0300" or not unicodedata.combining(c)])).casefold()


@dataclass(slots=True)
class Part:
    """An element: where its pieces begin and end, and the number of the element around it."""

    tag: str
    attrs: dict[str, str]
    around: int
    first: int
    last: int = -1


@dataclass(slots=True)
class Piece:
    text: str
    inside: int


@dataclass
class Outline(HTMLParser):
    html: str
    parts: list[Part] = field(default_factory=lambda: [Part("", {}, -1, 0)])
    pieces: list[Piece] = field(default_factory=list)

    def __post_init__(self):
        HTMLParser.__init__(self, convert_charrefs=True)
        self.open, self.said_by = [0], {}
        self.feed((self.html or "")[self._plain(self.html or ""):])
        self.close()
        self._end(0)

    def _plain(self, html: str) -> int:
        """Reads the plain markup at the head of a page; gives the place at which the rest begins."""
        at = 0
        while found := _PLAIN.match(html, at):
            text, tag, attrs, slash, ended = found.groups()
            after, raw, tag = found.end(), None, tag and tag.lower()
            if tag in _RAW and (slash or not (raw := _RAW[tag].search(html, after)) or not raw[0].isascii()):
                break
            if text:
                self.handle_data(unescape(text))
            if tag:
                pairs = _PAIRS.findall(attrs) if attrs else ()
                self.handle_starttag(tag, [(k.lower(), unescape(v[1:-1] if v[:1] in ("'", '"') else v)) for k, v in pairs])
                if slash:
                    self.handle_endtag(tag)
                elif raw:
                    self.handle_data(html[after:raw.start()])
                    self.handle_endtag(tag)
                    after = raw.end()
            elif ended:
                self.handle_endtag(ended.lower())
            at = after
        return at

    def _end(self, depth: int) -> None:
        for number in self.open[depth:]:
            self.parts[number].last = len(self.pieces)
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        self.parts.append(Part(tag, {k: v or "" for k, v in attrs}, self.open[-1], len(self.pieces)))
        if tag in VOID:
            self.parts[-1].last = len(self.pieces)
        else:
            self.open.append(len(self.parts) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.parts[self.open[depth]].tag == tag:
                self._end(depth)
                break

    def handle_data(self, data):
        if text := one_line(data):
            self.pieces.append(Piece(text, self.open[-1]))


@dataclass(slots=True)
class Flat:
    """A page as lists. Of its elements: the tag, the attributes (as written, or read), the element
    around, the range of pieces, the number after the last element inside. Of its pieces: the text and
    the element that directly holds it."""

    tags: list[str]
    attrs: list[str | dict[str, str]]
    around: list[int]
    first: list[int]
    last: list[int]
    until: list[int]
    texts: list[str]
    inside: list[int]
    said_by: list[tuple[int, str]] | None = None

    def shown(self) -> list[str]:
        return [t for t, n in zip(self.texts, self.inside) if self.tags[n] not in SILENT]

    def attributes(self, number: int) -> dict[str, str]:
        given = self.attrs[number]
        if isinstance(given, str):
            given = {k.lower(): unescape(v[1:-1] if v[:1] in ("'", '"') else v) for k, v in _PAIRS.findall(given)} if given else {}
            self.attrs[number] = given
        return given

    def block(self, heading: str) -> int | None:
        """The division around the first heading with these words, or what directly holds it."""
        if self.said_by is None:
            self.said_by = [
                (n, folded(" ".join(self.texts[self.first[n]:self.last[n]]))) for n, tag in enumerate(self.tags) if tag in HEADINGS]
        wanted = folded(heading)
        for number, said in self.said_by:
            if wanted in said:
                holds = division = self.around[number]
                while division > 0 and self.tags[division] != "div":
                    division = self.around[division]
                return division if division > 0 else holds
        return None

    def nearest(self, block: int, passes: Callable[[int], bool]) -> list[int | None]:
        """For a block and each element inside it in turn the innermost element from there outwards that
        passes, not beyond the block."""
        found = [block if passes(block) else None]
        for number in range(block + 1, self.until[block]):
            found.append(number if passes(number) else found[self.around[number] - block])
        return found

    def grouped(self, block: int, passes: Callable[[int], bool]) -> dict[int | None, list[int]]:
        """The numbers of a block's shown pieces by the innermost element around them that passes."""
        groups: dict[int | None, list[int]] = {}
        nearest = self.nearest(block, passes)
        for n in range(self.first[block], self.last[block]):
            if self.tags[self.inside[n]] not in SILENT:
                groups.setdefault(nearest[self.inside[n] - block], []).append(n)
        return groups

    def spanned(self, number: int) -> Iterator[int]:
        """The later elements whose pieces an element spans; of empty ones those that follow it directly as well."""
        end = self.last[number]
        for n in range(number + 1, len(self.tags)):
            if self.first[n] > end:
                break
            if self.last[n] <= end:
                yield n

    def said(self, numbers: list[int]) -> str:
        return " ".join([self.texts[n] for n in numbers])


def _skimmed(html: str) -> Flat | None:
    """A page of plain markup only, None for one with an odd place."""
    tags, attrs, around, first, last, until, texts, inside = [""], [""], [-1], [0], [0], [0], [], []
    stack, here, cut = [0], 0, _WHOLE.split(html)
    if len(cut) > 5 and cut[-2]:
        return None
    for at in range(0, len(cut), 6):
        text = None
        for chunk in cut[at].split("<"):
            if text is None:
                text = chunk
            else:
                bare, closed, text = chunk.partition(">")
                known = _BARE.get(bare) if closed else None
                given = ""
                if known is None:
                    if not (read := _TAG.match(chunk)):
                        return None
                    tag, given, slash, ended = read.groups()
                    tag, text = (tag or ended or "").lower(), chunk[read.end():]
                    if not ended and tag in _RAW:
                        return None
                    known = (_ENDS if ended else _NOTHING if not tag else _EMPTY if slash or tag in VOID else _OPENS), tag
                    if not given and len(_BARE) < 4096:
                        _BARE[bare] = known
                kind, tag = known
                if kind == _ENDS:
                    depth = len(stack) - 1
                    while depth and tags[stack[depth]] != tag:
                        depth -= 1
                    if depth:
                        for number in stack[depth:]:
                            last[number], until[number] = len(texts), len(tags)
                        del stack[depth:]
                        here = stack[-1]
                elif kind != _NOTHING:
                    number = len(tags)
                    tags.append(tag)
                    attrs.append(given)
                    around.append(here)
                    first.append(len(texts))
                    last.append(len(texts))
                    until.append(number + 1)
                    if kind == _OPENS:
                        stack.append(number)
                        here = number
            if text:
                if "&" in text:
                    text = unescape(text)
                if text := " ".join(text.split()):
                    texts.append(text)
                    inside.append(here)
        if at + 1 < len(cut) and (ended := cut[at + 4]):
            if not ended.isascii():
                return None
            tags.append("script" if cut[at + 1] else "style")
            attrs.append(cut[at + 2])
            around.append(here)
            first.append(len(texts))
            if text := " ".join(cut[at + 3].split()):
                texts.append(text)
                inside.append(len(tags) - 1)
            last.append(len(texts))
            until.append(len(tags))
    for number in stack:
        last[number], until[number] = len(texts), len(tags)
    return Flat(tags, attrs, around, first, last, until, texts, inside)


def flat(html: str | None) -> Flat:
    if page := _skimmed(html or ""):
        return page
    page = Outline(html)
    columns = zip(*[(p.tag, p.attrs, p.around, p.first, p.last) for p in page.parts])
    until = list(range(1, len(page.parts) + 1))
    for number in range(len(until) - 1, 0, -1):
        around = page.parts[number].around
        until[around] = max(until[around], until[number])
    return Flat(*map(list, columns), until, [p.text for p in page.pieces], [p.inside for p in page.pieces])


def distinct(texts) -> list[str]:
    """Texts that differ in more than case, first spelling, in order."""
    kept: dict[str, str] = {}
    for text in filter(None, texts):
        kept.setdefault(text.casefold(), text)
    return list(kept.values())


def addresses(body: str) -> list[str]:
    """The strings of address-like fields at any depth of a JSON text, outer fields first; none if
    the text is not JSON or too deep to read."""
    try:
        waiting, found = [json.loads(body)], []
    except (ValueError, RecursionError):
        return []
    while waiting:
        value = waiting.pop()
        if isinstance(value, dict):
            held = [value[name] for name in ADDRESS_FIELDS if name in value]
            found += [v for h in held for v in (h if isinstance(h, list) else [h]) if isinstance(v, str)]
            value = list(value.values())
        if isinstance(value, list):
            waiting += value[::-1]
    return found


def section(page: Flat, heading: str) -> tuple[str | None, list[str]] | None:
    """Paragraphs and list items of the block under a heading, without the heading."""
    block = page.block(heading)
    if block is None:
        return None
    tags, wanted = page.tags, folded(heading)
    paragraphs = [page.said(g) for g in page.grouped(block, lambda n: tags[n] in ("p", "div")).values()]
    listed = page.grouped(block, lambda n: tags[n] == "li")
    rows = [page.said(g) for where, g in listed.items() if where is not None]
    other = [t for t in paragraphs if wanted not in folded(t)]
    pieces = [] if other and rows else [t for g in listed.values() for n in g if wanted not in folded(t := page.texts[n])]
    return "\n\n".join(distinct(other or pieces)) or None, distinct(rows or pieces)


def _role(names: list[str]) -> str | None:
    """What class names tell of a piece of text."""
    names = [n.lower() for n in names]
    return next((role for role, words in ROLES.items() if any(w in n for n in names for w in words)), None)


def points(page: Flat, heading: str) -> list[tuple]:
    """(type, name, distance text, whether that text holds more than the distance) of each point in
    the block under a heading: an item's texts by the roles that class names give them."""
    block = page.block(heading)
    if block is None:
        return []

    # Only elements with attributes have classes, so what the others would be asked is known.
    attrs = {n: page.attributes(n) for n in (block, *page.spanned(block)) if page.attrs[n]}
    classes = {n: given["class"].split() for n, given in attrs.items() if given.get("class")}
    roles = {n: role for n, names in classes.items() if (role := _role(names)) is not None}

    def is_item(number: int) -> bool:
        return page.tags[number] == "li" or number in attrs and (
            "nearbyPoint" in classes.get(number, ()) or "data-distance" in attrs[number] and number not in roles)

    typed = [n for n, names in classes.items() if n != block and "type" in names]
    rows = set()
    if typed:
        division = page.nearest(block, lambda n: page.tags[n] == "div")
        # The empty elements right behind the block lie in none of its divisions.
        rows = {division[at - block] for n in typed if block <= (at := page.around[n]) < page.until[block]}
    groups = page.grouped(block, rows.__contains__ if typed else is_item)
    named = page.nearest(block, roles.__contains__)
    found = []
    for where, numbers in groups.items():
        if where is None or where == block and not typed:
            continue
        texts: dict[str, list[int]] = {}
        for n in numbers:
            # The nearest role counts if it lies inside the row.
            if (by := named[page.inside[n] - block]) is not None and by > where:
                texts.setdefault(roles[by], []).append(n)
        kind, name, far = (page.said(texts[r]) if r in texts else None for r in ROLES)
        if typed:
            found.append((kind, name, far, False))
            continue
        inner = (attrs[n].get("data-distance") for n in page.spanned(where) if n in attrs)
        far = far or next((one_line(d) for d in inner if d), None)
        own = one_line(attrs.get(where, {}).get("data-type")) or None
        found.append((kind or own, name or page.said(numbers), far or page.said(numbers), far is None))
    return found

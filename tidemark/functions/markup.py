"""Expressions that read HTML text where no nesting has to be followed."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let, normalize_space

# Every named reference of HTML with what it stands for, the no-break space as a blank. Those that pages
# use most come first, because a constant map is searched from its front.
_VALUES = {name: " " if value == "\xa0" else value for name, value in html5.items()}
_FRONT = ("amp;", "quot;", "lt;", "gt;", "apos;", "nbsp;")
_NAMES = sorted((n for n in _VALUES if n.endswith(";")), key=lambda n: (n not in _FRONT, max(map(ord, html5[n])), n))
# Names that count without a semicolon as well; the longest that a text begins with is meant.
_BARE = sorted((n for n in _VALUES if not n.endswith(";")), key=lambda n: (-len(n), n))
# Numbers 0x80 to 0x9F mean the characters of Windows-1252, where it has any.
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))

# Blocks that are not text, each taken whole; a break stands in for them.
# A single sign at the head, since alternatives are tried at every character.
_SILENT = r"(?is)<(?:!--.*?-->|!doctype[^>]*>|(script|style|noscript|template)\b.*?</\1\s*>)"


def _constant_map(names: list[str]) -> Column:
    # Two split literals, which the optimiser folds to one constant map.
    return F.map_from_arrays(F.split(F.lit(" ".join(names)), " "), F.split(F.lit("\x00".join(_VALUES[n] for n in names)), "\x00"))


def _numbered(digits: Column) -> Column:
    """The character of a decimal or x-led hexadecimal number, as browsers read it."""
    plain = F.regexp_replace(digits, "^[xX]?0*", "")
    hexed = F.when(F.length(plain) <= 8, F.conv(plain, 16, 10))
    code = F.when(plain == "", "0").when(digits.rlike("^[xX]"), hexed).otherwise(plain).try_cast("bigint")

    def char(code: Column) -> Column:
        unknown = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        silent = code.between(1, 8) | code.isin(11, 127) | code.between(14, 31) | code.between(0xFDD0, 0xFDEF) | (
            code.bitwiseAND(F.lit(0xFFFE).cast("bigint")) == 0xFFFE)
        return (
            F.when(unknown, "\ufffd").when(silent, "").when(code == 0xA0, " ")
            .when(code.between(0x80, 0x9F), F.substring(F.lit(_CP1252), (code - 0x7F).cast("int"), F.lit(1)))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        )

    return let(code, char)


def unescape(c) -> Column:
    """The text with its named and numeric character references decoded, once, with or without their
    semicolon where HTML allows it; others stay."""
    named, bare = _constant_map(_NAMES), _constant_map(_BARE)

    def read(piece: Column, pattern: str, value) -> Column:
        """What a reference at the piece's head stands for and the rest; NULL without one."""
        found = let(F.nullif(F.regexp_extract(piece, pattern, 1), F.lit("")), value)
        return F.concat(found, F.regexp_replace(piece, pattern, ""))

    def decoded(piece: Column) -> Column:
        number = read(piece, r"^#([0-9]+|[xX][0-9a-fA-F]+);?", lambda d: F.when(d.isNotNull(), _numbered(d)))
        return F.when(piece.startswith("#"), F.coalesce(number, F.concat(F.lit("&"), piece))).otherwise(F.coalesce(
            read(piece, r"^([A-Za-z][A-Za-z0-9]{1,31};)", lambda name: named[name]),
            read(piece, f"^({'|'.join(_BARE)})", lambda name: bare[name]),
            F.concat(F.lit("&"), piece),
        ))

    pieces = F.split(_col(c), "&")
    rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    return F.when(_col(c).contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))).otherwise(_col(c))


def without_silent_blocks(c) -> Column:
    return F.regexp_replace(_col(c), _SILENT, "<br>")


def text_pieces(c) -> Column:
    """The pieces of text between tags, in order, spaces normalised, blank ones left out."""
    pieces = F.split(without_silent_blocks(c), r"<[^>]*>")
    return F.filter(F.transform(pieces, lambda p: normalize_space(unescape(p))), lambda p: p != "")


def flat_text(c) -> Column:
    """All text of a fragment on one line."""
    return F.array_join(text_pieces(c), " ")


def element_text(c, tag: str) -> Column:
    """Text of the first element of a name, NULL without one."""
    return F.nullif(flat_text(F.regexp_extract(_col(c), rf"(?is)<(?:{tag})\b[^>]*>(.*?)</(?:{tag})\s*>", 1)), F.lit(""))


_VALUE = r"(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"


def _unquoted(raw: Column) -> Column:
    """A raw attribute value without its quotes; '' stands for no attribute at all."""
    inner = F.when(raw.rlike("^[\"']"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(raw != "", unescape(inner))


def attribute(tag, name: str) -> Column:
    """An attribute of one tag's text, NULL where it is not there."""
    return let(F.regexp_extract(_col(tag), rf"(?is)\s{name}\s*=\s*" + _VALUE, 1), _unquoted)


def attributes_in_order(tag: Column, names: list[str]) -> Column:
    """The values of some attributes of one tag, in the order of ``names``."""
    pattern = F.lit(rf"(?is)\s({'|'.join(names)})\s*=\s*" + _VALUE)
    found = F.arrays_zip(
        F.regexp_extract_all(tag, pattern, F.lit(1)).alias("name"), F.regexp_extract_all(tag, pattern, F.lit(2)).alias("raw")
    )
    rank = F.array(*[F.lit(n) for n in names])
    ranked = F.transform(found, lambda f: F.struct(F.array_position(rank, F.lower(f["name"])).alias("at"), f["raw"].alias("raw")))
    return F.transform(F.sort_array(ranked), lambda f: _unquoted(f["raw"]))


def first_tag(c, pattern: str) -> Column:
    """The first tag that matches, as text, NULL without one."""
    return F.nullif(F.regexp_extract(_col(c), "(?is)" + pattern, 0), F.lit(""))


def meta_content(c, name: str) -> Column:
    tag = first_tag(c, rf"<meta\b(?=[^>]*\b(?:property|name)\s*=\s*[\"']{name}[\"'])[^>]*>")
    return F.nullif(normalize_space(attribute(tag, "content")), F.lit(""))


def link_href(c, rel: str) -> Column:
    return attribute(first_tag(c, rf"<link\b(?=[^>]*\brel\s*=\s*[\"'][^\"']*\b{rel}\b)[^>]*>"), "href")


def tags_of(c, attributes: str) -> Column:
    """Every opening tag of a fragment that has one of the attributes, in order."""
    with_one = rf"<[A-Za-z](?=[^>]*?\s(?i:{attributes})\s*=)[^>]*>"
    return F.regexp_extract_all(without_silent_blocks(c), F.lit(with_one), F.lit(0))



"""Links out of page text, as Column -> Column functions.

A page is cut into tokens the way browsers do: comments, declarations, tags with their attributes,
elements whose content is plain text, and text. Every repetition is possessive, so a match neither
goes back nor nests, whatever the page; a token starts where the one before ended, so quoted
markup, comments and scripts never yield links. A tag that the page never ends swallows its rest.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, functions as F

# Elements whose content has no tags.
RAW_ELEMENTS = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")

_ENDS = r"(?=[\s/>])"
_VALUE = r"""[^\s>"'][^\s>]*+|"[^"]*+"|'[^']*+'|(?=>)"""


def _attribute_pattern(group: str) -> str:
    """Name and value; an equals sign has to be followed by a value that ends."""
    return rf"{group}[^\s/>][^\s/>=]*+)(?:(?!\s*+=)|\s*+=\s*+{group}{_VALUE}))"


_ATTRIBUTES = rf"(?:[\s/]++|{_attribute_pattern('(?:')})*+"
_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
_RAW = "|".join(rf"<{e}{_ENDS}{_ATTRIBUTES}>.*?(?=</{e}[\s/>]|\z)" for e in RAW_ELEMENTS)
_TAG = rf"</?[a-z][^\s/>]*+{_ATTRIBUTES}>"
_UNENDED = r"</?[a-z].*+\z"
_OTHER = r"<[!?/][^>]*+(?:>|\z)"
_TOKEN = rf"(?:{_COMMENT}|{_RAW}|{_TAG}|{_UNENDED}|{_OTHER}|[^<]++|<)"
_OPENING = rf"<a{_ENDS}{_ATTRIBUTES}>"
# An anchor ends at its end tag, at the next anchor, as anchors do not nest, or with the page.
_ANCHOR = rf"(?is)\G(?:(?!{_OPENING}){_TOKEN})*+({_OPENING}(?:(?!</?a{_ENDS}){_TOKEN})*+)"

# Named references that end in a semicolon; one text that Spark turns into one constant map.
_NAMED = "\x01".join(f"{k[:-1]}\x02{v}" for k, v in html5.items() if k.endswith(";"))


def _reference(piece: Column) -> Column:
    """The text of a character reference; other pieces, and unknown names, as they are."""
    body = F.substr(piece, F.lit(2), F.length(piece) - 2)
    digits = F.substr(body, F.lit(2))
    code = F.when(body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10)).otherwise(digits).cast("long")
    legal = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    number = F.decode(F.unhex(F.lpad(F.hex(F.when(legal, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
    named = F.try_element_at(F.str_to_map(F.lit(_NAMED), F.lit("\x01"), F.lit("\x02")), body)
    return F.when(~piece.rlike("^&.+;$"), piece).when(piece.startswith("&#"), number).otherwise(F.coalesce(named, piece))


def decoded(text: Column) -> Column:
    """Text with character references, which end in a semicolon, replaced by what they stand for.

    Numbers that are no character become U+FFFD.
    """
    pieces = F.regexp_extract_all(
        text, F.lit(r"(?s)&(?:#[xX][0-9a-fA-F]{1,8}|#[0-9]{1,9}|[a-zA-Z][a-zA-Z0-9]{0,40});|[^&]++|&"), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, _reference), "")).otherwise(text)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _attribute(names: Column, values: Column, name: str) -> Column:
    """The first attribute of that name, decoded; NULL without one."""
    def value(at: Column) -> Column:
        raw = F.regexp_replace(F.get(values, (at - 1).cast("int")), r"""(?s)^(["'])(.*)\1$""", "$2")
        return F.when(at > 0, _let(raw, decoded))

    return _let(F.array_position(names, name), value)


def anchors(page: Column) -> Column:
    """The anchors of a page in order, as an array of (href, original, text).

    ``href`` and ``original`` are the attributes href and data-original-url as written, ``text`` is
    all text inside, decoded, without tags, comments and elements of plain content. NULL pages
    have NULL.
    """
    found = F.regexp_extract_all(page, F.lit(_ANCHOR), F.lit(1))

    def read(anchor: Column) -> Column:
        return _let(F.regexp_extract(anchor, f"(?is)^{_OPENING}", 0), lambda opening: opened(anchor, opening))

    def opened(anchor: Column, opening: Column) -> Column:
        inside = F.regexp_extract_all(
            F.substr(anchor, F.length(opening) + 1), F.lit(rf"(?is)\G{_TOKEN}"), F.lit(0))
        text = F.array_join(F.filter(inside, lambda t: ~t.rlike("^<[!?/a-zA-Z]")), "")
        names, values = (F.regexp_extract_all(
            F.substr(opening, F.lit(3)), F.lit(f"(?is){_attribute_pattern('(')}"), F.lit(i)) for i in (1, 2))
        return _let(F.transform(names, F.lower), lambda names: _let(values, lambda values: F.struct(
            _attribute(names, values, "href").alias("href"), _attribute(names, values, "data-original-url").alias("original"),
            _let(text, decoded).alias("text"))))

    return F.transform(found, read)

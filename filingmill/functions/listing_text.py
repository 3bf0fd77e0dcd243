"""Reading company names out of listing lines and links, as Column -> Column functions.

Patterns are kept in the plain form of the browser side; ``_java`` gives ``\\s`` and ``\\b``
the meaning they have there: whitespace with the byte order mark, and words of ASCII letters.

Hardly any place in a line starts a match, so alternatives stand behind one look at the first
character they can have, and patterns that need a certain character are asked only where it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..config import Listing
from .text import blank_to_null

# Texts that are never a company.
NOT_COMPANY_TEXT = (
    r"^(?:\d+\s+school alumni|promoted$|in\s+easy apply$|\d+\s+(day|week|month)s?\s+ago$)",
    r"(?=[$/4])(?:\$\d|\/yr|401\s*\(\s*k\s*\))",
)
MAX_TEXT = 200

# What a location looks like.
WORKPLACE = r"\(remote\)|\(on-site\)|\(hybrid\)"
CITY_AND_CODE = r",\s*[A-Z]{2}(\s|$|\))"

# What a company name may not contain, and its length.
NOT_IN_NAME = (
    r"(?=[fpis\d])(?:followers|premium|insights|show\s+|\d,\d{3})",
    r"^[\d,.\s]+$",
)
NAME_LENGTH = (2, 70)

# How lines of a listing row are told apart.
LINE_LOCATION = r"\b(remote|hybrid|on[\s-]?site)\b|,\s*[A-Z]{2}\b|\([A-Za-z\s]+,\s*[A-Z]{2}\)"
LINE_META = (
    r"^(?:[•·\-–—]+$|be an early|easy apply|actively|get job alerts|your feedback|show|[\d,]+$)"
    r"|(?=[abehprv\d%])(?:promoted jobs are ranked|how promoted|%"
    r"|\d(?:\+?\s*results?|\s*(benefit|connection|applicant|result|follower)s?)\b"
    r"|\b(ago|viewed|about|premium|easy apply|actively|posted|reposted|be an early applicant)\b)"
)
LINE_JOB_TITLE = (
    r"\b(engineer|developer|architect|manager|analyst|scientist|designer|consultant|specialist"
    r"|director|lead|senior|junior|staff|principal|intern|associate|founder|officer|executive"
    r"|full[\s-]?stack|front[\s-]?end|back[\s-]?end|machine[\s-]?learning|software|generative"
    r"|agentic|emerging)\b"
)
LINE_LENGTH = (2, 60)

# Whitespace of the browser: no ASCII separators, but the byte order mark.
_SPACES = (
    "\t\n\x0b\x0c\r \xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_WORD = "[A-Za-z0-9_]"


def _java(pattern: str) -> str:
    # Every ``\b`` in use stands before or after a whole word, so looking at one side is enough.
    opening, closing = f"(?<!{_WORD})", f"(?!{_WORD})"
    pattern = re.sub(r"(^|[|(:])\\b", lambda m: m.group(1) + opening, pattern)
    pattern = pattern.replace(r"\b", closing)
    return "(?id)" + pattern.replace(r"\s", _SPACE)


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(_java(pattern))


def length(c: Column) -> Column:
    """Length in UTF-16 units, as the browser counts it."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def _any(*patterns: str) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def tidy(c: Column) -> Column:
    """Single spaces inside, none at the ends."""
    # Plain text with single blanks, as nearly all is, has nothing to replace and only blanks to trim.
    odd = F.octet_length(c) > F.char_length(c)
    for space in ("  ", *"\t\n\x0b\x0c\r"):
        odd = odd | c.contains(space)
    return F.when(odd, F.btrim(F.regexp_replace(c, _java(r"\s+"), " "), F.lit(_SPACES))).otherwise(F.trim(c))


def if_text(t: Column) -> Column:
    """``company_text`` of text that is tidied already."""
    return F.when(~_has(t, _any("^$", *NOT_COMPANY_TEXT)) & (length(t) <= MAX_TEXT), t)


def company_text(c: Column) -> Column:
    """Tidied text, or NULL where it cannot hold a company."""
    return if_text(tidy(c))


def is_row_line(t: Column) -> Column:
    """Whether tidied text passes ``company_text`` and is no junk line."""
    fits = length(t).between(LINE_LENGTH[0], MAX_TEXT) & ~_has(t, _any(*NOT_COMPANY_TEXT, LINE_META))
    return F.coalesce(fits, F.lit(False))


def looks_like_location(c: Column) -> Column:
    """True for a line that is a place as a whole; also for NULL and blank."""
    workplace = c.contains("(") & _has(c, WORKPLACE)
    undivided = c.contains(",") & ~c.contains("·") & _has(c, CITY_AND_CODE)
    return F.coalesce(c.isin("", "\n") | workplace | undivided, F.lit(True))


def is_company_name(c: Column) -> Column:
    ok = length(c).between(*NAME_LENGTH) & ~_has(c, _any(*NOT_IN_NAME))
    return F.coalesce(ok, F.lit(False))


def company_of_text(t: Column) -> Column:
    """Of ``company_text``: the first ``·``-separated part that is a company and no place."""
    parts = F.transform(F.split(t, "·"), lambda p: if_text(F.btrim(p, F.lit(_SPACES))))
    fit = F.filter(parts, _is_company_part)
    return F.when(t.contains("·"), F.try_element_at(fit, F.lit(1))).when(_is_company_part(t), t)


def company_of_line(c: Column) -> Column:
    """The company a raw line names, if any."""
    return company_of_text(company_text(c))


def _is_company_part(c: Column) -> Column:
    return ~looks_like_location(c) & is_company_name(c)


def company_slug(url: Column, cfg: Listing = Listing()) -> Column:
    """Decoded company part of a profile address; NULL without one."""
    raw = F.regexp_extract(url, f"(?i){cfg.company_path}", 1)
    slug = F.btrim(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), F.lit(_SPACES))
    return F.nullif(blank_to_null(slug), F.lit(cfg.unavailable_slug))


def name_of_slug(slug: Column) -> Column:
    return tidy(F.replace(slug, F.lit("-"), F.lit(" ")))


def company_of_link(text: Column, url: Column, cfg: Listing = Listing()) -> Column:
    """Name from the link's text, else from its address."""
    from_slug = name_of_slug(company_slug(url, cfg))
    return F.coalesce(company_of_line(text), F.when(is_company_name(from_slug), from_slug))


def is_junk_line(c: Column) -> Column:
    return F.coalesce((length(c) < LINE_LENGTH[0]) | _has(c, LINE_META), F.lit(True))


def is_job_title_line(c: Column) -> Column:
    return _has(c, LINE_JOB_TITLE)


def is_location_line(c: Column) -> Column:
    return _has(c, LINE_LOCATION)


def can_be_company_line(c: Column) -> Column:
    return length(c).between(*LINE_LENGTH) & ~_has(
        c, _any(LINE_JOB_TITLE, LINE_LOCATION, LINE_META))


def outcome_label(sponsors: Column, cfg: Listing = Listing()) -> Column:
    return F.when(sponsors, cfg.label_yes).otherwise(cfg.label_no)


def client_id(forwarded: Column, host: Column) -> Column:
    """First forwarded address, else the peer address, else ``unknown``."""
    first = F.btrim(F.split(blank_to_null(forwarded), ",")[0], F.lit(_SPACES))
    return F.coalesce(first, host, F.lit("unknown"))

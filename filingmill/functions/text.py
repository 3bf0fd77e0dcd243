"""Text cleaning as Column -> Column functions.

Everything here is a built-in expression, so it runs inside the generated code of the scan
stage. Whitespace means Unicode whitespace plus the four ASCII separators, which ``trim``
and a bare ``\\s`` both miss.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The characters that count as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS = r"[\s\x1c-\x1f]"

# Texts that stand for "no value".
PLACEHOLDERS = ("", "nan", "none", "n/a", "#n/a", "null")

# Legal suffixes that lose their period.
SUFFIXES = ("INC", "LLC", "CORP", "CO", "LTD")

# The wage levels that exist.
WAGE_LEVELS = ("I", "II", "III", "IV")


def strip(c: Column) -> Column:
    """Remove whitespace from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def squeeze(c: Column) -> Column:
    """Turn every run of whitespace into one space."""
    return F.regexp_replace(c, f"(?U){_WS}+", " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def is_missing(c: Column) -> Column:
    """True for NULL, blanks and placeholder texts; never NULL itself."""
    return c.isNull() | F.lower(strip(c)).isin(*PLACEHOLDERS)


def present(c: Column) -> Column:
    """The value, or NULL where it is missing."""
    return F.when(~is_missing(c), c)


def employer_name(c: Column) -> Column:
    """The key every table is joined on: upper case, single spaces, no suffix periods.

    The period goes wherever the suffix occurs, in one pass per suffix.
    """
    spaced = squeeze(F.upper(strip(present(c))))
    return blank_to_null(strip(reduce(
        lambda s, suffix: F.replace(s, F.lit(f" {suffix}."), F.lit(f" {suffix}")),
        SUFFIXES, spaced)))


def job_title(c: Column) -> Column:
    """Titles without bracketed remarks and seniority tails, abbreviations spelled out.

    Brackets go before the tails are looked at and leave their spaces behind, so a tail
    in front of a bracket stays.
    """
    s = F.upper(strip(present(c)))
    s = F.regexp_replace(s, r"(?d)\(.*?\)", "")
    for tail in ("-SENIOR", "-JR"):
        s = strip(F.regexp_replace(s, f"(?d){tail}$", ""))
    for short, full in (("SR", "SENIOR "), ("JR", "JUNIOR ")):
        s = F.regexp_replace(s, rf"(?U)\b{short}\.{_WS}+", full)
    s = F.regexp_replace(s, r"(?U)\bMGR\b", "MANAGER")
    return blank_to_null(strip(squeeze(s)))


def wage_level(c: Column) -> Column:
    s = F.upper(strip(c))
    return F.when(s.isin(*WAGE_LEVELS), s)


def yes_no(c: Column) -> Column:
    s = F.upper(strip(c))
    return F.when(s == "Y", True).when(s == "N", False)


def plain_key(c: Column) -> Column:
    """The older name key: stripped upper case and nothing else."""
    return F.upper(strip(c))


def date_text(c: Column) -> Column:
    """ISO text for the four accepted layouts; any other text comes back stripped.

    Layouts are told apart by pattern first, so no row pays for a failed parse.
    """
    s = strip(present(c))
    iso = F.regexp_replace(s, r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$", "$4-$1-$3")
    iso = F.regexp_replace(iso, r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3")
    looks_iso = iso.rlike(r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$")
    return F.coalesce(F.when(looks_iso, iso.try_cast("date").cast("string")), s)


def iso_day(c: Column) -> Column:
    """A text that is exactly an ISO day as a date, else NULL."""
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))
    return F.when(day.cast("string") == c, day)


def year_of(c: Column) -> Column:
    """Leading four characters as a year; NULL when they are no number."""
    return F.when(F.char_length(c) >= 4, F.substring(c, 1, 4).try_cast("int"))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, two decimals, half to even."""
    return F.bround(part / whole * 100, 2)


def has_wildcard(c: Column) -> Column:
    """True where LIKE would read a character of the text as syntax."""
    return c.rlike(r"[%_\\]")

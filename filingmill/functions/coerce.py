"""Typed values out of all-text tables; bad text becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_to_null, strip

# The spellings of a flag.
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")


def to_text(c: Column) -> Column:
    return blank_to_null(strip(c))


def to_int(c: Column) -> Column:
    return F.when(strip(c).rlike(r"^[+-]?\d+$"), strip(c).try_cast("int"))


def to_float(c: Column) -> Column:
    return to_text(c).try_cast("double")


def to_bool(c: Column) -> Column:
    word = F.lower(strip(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def to_date(c: Column) -> Column:
    return to_text(c).try_cast("date")

"""Repeated extraction attempts per card, and reports of cards given up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Listing
from . import prefix
from .intake import first_per_key

SNIPPET = 300
REPORT_SNIPPET = 500


def abandoned(
    attempts: DataFrame,
    failed: Column,
    card: str = "card_id",
    ts: str = "ts",
    key: str = "event_id",
    max_attempts: int = Listing.max_attempts,
    chunk: str | None = None,
) -> DataFrame:
    """Per card its attempts, failures and the attempt at which it was given up, if any.

    A success sets the count back; the card is given up at its ``max_attempts``-th failure
    in a row and stays so.
    """
    return counted(attempts, failed, card, ts, key, max_attempts, chunk).select(
        card, "attempts", "failures", F.col("up").isNotNull().alias("abandoned"),
        F.col("up")[key].alias(f"abandoned_{key}"))


def counted(
    attempts: DataFrame, failed: Column, card: str, ts: str, key: str, max_attempts: int, chunk: str | None = None,
) -> DataFrame:
    """Per card attempts, failures, ``up`` (ts, key) where it was given up, ``last`` (ts, key), and ``in_row`` failures there.

    Failures since the last success are the running count of failures less its value at that
    success; both are worked out inside ranges of rows, or inside a unit of time, and carried on.
    """
    rows = attempts.select(card, ts, key, failed.alias("_failed"))
    if chunk is None:
        rows, part = prefix.ranged(rows, ts, key), F.col("_range")
    else:
        part = F.date_trunc(chunk, F.col(ts)).cast("timestamp").cast("long")
    fails = F.col("_fails")

    def inside(w):
        return [{"_fails": F.count_if("_failed").over(prefix.so_far(w))},
                {"_at_ok": F.max(F.when(~F.col("_failed"), fails)).over(prefix.so_far(w))}]

    def carry(w):
        return [{"_fails_before": F.coalesce(F.sum("_c_fails").over(prefix.before(w)), F.lit(0))},
                {"_ok_before": F.coalesce(F.max(
                    F.col("_fails_before") + F.col("_c_at_ok")).over(prefix.before(w)), F.lit(0))}]

    each = prefix.along(
        rows, [card], part, [ts, key], inside,
        {"_c_fails": F.max("_fails"), "_c_at_ok": F.max("_at_ok")}, carry)
    in_row = F.when(F.col("_at_ok").isNotNull(), fails - F.col("_at_ok")).otherwise(
        fails + F.col("_fails_before") - F.col("_ok_before"))
    place = F.struct(ts, key)
    return each.groupBy(card).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if("_failed").alias("failures"),
        F.min(F.when(F.col("_failed") & (in_row >= max_attempts), place)).alias("up"),
        F.max(place).alias("last"), F.max_by(F.when(F.col("_failed"), in_row).otherwise(F.lit(0)), place).alias("in_row"))


def miss_reports(
    misses: DataFrame, card: str = "card_id", order: tuple[str, ...] = ("ts", "event_id")
) -> DataFrame:
    """One report per card, its first, with the page text cut to the reported length."""
    # Cut first: only the reported part of a page has to move.
    cut = misses.withColumn("html", F.substring(F.coalesce("html", F.lit("")), 1, SNIPPET))
    return first_per_key(cut, [card], list(order))


def logged_snippet(html: Column) -> Column:
    return F.substring(F.coalesce(html, F.lit("")), 1, REPORT_SNIPPET)


def misses_per_url(reports: DataFrame) -> DataFrame:
    return reports.groupBy("url").agg(F.count(F.lit(1)).alias("misses"))

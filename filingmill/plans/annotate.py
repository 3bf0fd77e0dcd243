"""Listings -> company -> resolution -> label."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..config import Listing
from ..functions import listing_text as lt
from ..operators import listings
from ..operators.materialize import materialize
from .resolve import check, resolve


def companies(
    lines: DataFrame,
    links: DataFrame,
    cfg: Listing = Listing(),
    detail_links: DataFrame | None = None,
    detail_blocks: DataFrame | None = None,
    texts: Mapping[int, DataFrame] | None = None,
) -> DataFrame:
    """card_id, company_name, priority for cards a name can be read from.

    ``lines`` and ``links`` are those of list cards; ``detail_links`` and ``detail_blocks`` those
    of detail panels, given together. ``texts`` has the element texts (card_id, ord, text) of
    the other places, by their number: selectors, lockups, primary descriptions, fallbacks.
    """
    found = [listings.line_candidates(lines), listings.link_candidates(links, cfg)]
    if detail_links is not None and detail_blocks is not None:
        found.append(listings.detail_candidates(detail_links, detail_blocks, cfg))
    found += [listings.text_candidates(rows, place) for place, rows in (texts or {}).items()]
    return listings.best_candidate(*found)


def annotate(
    lines: DataFrame,
    links: DataFrame,
    employers: DataFrame,
    aliases: DataFrame,
    cfg: Listing = Listing(),
    places: Mapping[str, object] | None = None,
    **resolve_options,
) -> DataFrame:
    """Every card with a company: the answer for the company and its label.

    ``places`` are the further arguments of ``companies``.
    """
    # Read twice below: for the distinct names, and to put the answers back.
    cards = materialize(
        companies(lines, links, cfg, **(places or {})).select("card_id", "company_name"), "cards")
    answers = check(resolve(cards, employers, aliases, raw_name="company_name", **resolve_options))
    return answers.withColumn("label", lt.outcome_label(F.col("sponsors_h1b"), cfg))

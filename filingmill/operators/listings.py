"""From listing lines and links to one company name per card."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Listing
from ..functions import html as markup
from ..functions import listing_text as lt
from .intake import first_per_key

# Places in the order of trust; the first that yields a name wins.
# A card is in the list or in a detail panel, so lines and details never compete.
LINE, DETAIL, SELECTOR, LOCKUP, PRIMARY, LINK_TEXT, LINK_SLUG, LATE_LOCKUP, FALLBACK = range(1, 10)

ROW_LINES = (2, 6)


def _with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once per row, however often it is used.

    An expression is copied into every place that uses it, and a filter on it is pushed down
    together with a second copy; the output of ``explode`` stays where it is.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def _with_value(df: DataFrame, name: str, value: Column, keep=lambda v: v.isNotNull()) -> DataFrame:
    """Add a column and drop the rows where it does not fit, working it out once per row."""
    return _with_once(df, name, value).where(keep(F.col(name)))


def _with_company(df: DataFrame, text: Column) -> DataFrame:
    """The rows whose raw ``text`` names a company, with its name."""
    tidy = _with_value(df, "_tidy", lt.tidy(text))
    fit = _with_value(tidy, "_text", lt.if_text(F.col("_tidy")))
    return _with_value(fit, "name", lt.company_of_text(F.col("_text"))).drop("_tidy", "_text")


def card_lines(lines: DataFrame) -> DataFrame:
    """Tidied lines of each row without junk, each text once at its first place.

    A row is a card and a depth: 0 for the card itself, more for the elements around it.
    """
    if "depth" not in lines.columns:
        lines = lines.withColumn("depth", F.lit(0))
    tidy = _with_value(
        lines.select("card_id", "depth", "line_no", "line_text"), "text",
        lt.tidy(F.col("line_text")), lt.is_row_line)
    return tidy.groupBy("card_id", "depth", "text").agg(F.min("line_no").alias("line_no"))


def tight_rows(lines: DataFrame) -> DataFrame:
    """Rows with a plausible number of lines for one listing."""
    return lines.groupBy("card_id", "depth").agg(F.count(F.lit(1)).alias("lines")).where(
        F.col("lines").between(*ROW_LINES)).select("card_id", "depth")


def company_lines(lines: DataFrame) -> DataFrame:
    """The line of each row that names the company.

    The first longest line is the job title; the company is the first fitting line besides
    it. So each line stands for itself as a title and, if it fits, as a company, and the
    first two of either kind decide: that many are kept per row before the shuffle.
    Returns card_id, depth, line_no, name.
    """
    text, row = F.col("text"), ["card_id", "depth"]
    as_title = F.struct(
        F.lit(True).alias("title"), (-lt.length(text)).alias("rank"), "line_no", "text")
    as_company = F.when(lt.can_be_company_line(text), F.struct(
        F.lit(False).alias("title"), F.lit(0).alias("rank"), "line_no", "text"))
    roles = card_lines(lines).select(*row, F.explode(F.array(as_title, as_company)).alias("r")).where(
        "r is not null")
    nth = F.row_number().over(
        Window.partitionBy(*row, "title").orderBy("rank", "line_no"))
    first = roles.select(*row, "r.*").withColumn("_nth", nth).where("_nth <= 2")
    # At most four short entries per row.
    title_no = F.max(F.when(F.col("title") & (F.col("_nth") == 1), F.col("line_no")))
    companies = F.array_sort(F.collect_list(F.when(~F.col("title"), F.struct("line_no", "text"))))
    decided = first.groupBy(*row).agg(title_no.alias("title_no"), companies.alias("companies"))
    other = F.filter("companies", lambda c: c["line_no"] != F.col("title_no"))
    named = decided.select(*row, F.try_element_at(other, F.lit(1)).alias("l")).select(*row, "l.*")
    name = F.coalesce(lt.company_of_text(text), text)
    return _with_value(named, "name", name, lt.is_company_name).drop("text")


def line_candidates(lines: DataFrame) -> DataFrame:
    """Company lines of cards; rows around a card count only when they are tight."""
    picked = company_lines(lines)
    if "depth" in lines.columns:
        tight = tight_rows(lines).where("depth > 0")
        own = picked.where("depth = 0")
        picked = own.unionByName(picked.join(tight, ["card_id", "depth"], "left_semi"))
    return picked.select(
        "card_id", F.lit(LINE).alias("priority"), F.col("depth").cast("long").alias("ord"), "name")


def page_links(pages: DataFrame, key: str = "card_id", html: str = "html") -> DataFrame:
    """(key, link_no, href, link_text): the links of page text, numbered from 0 in their order.

    The address is the anchor's href, or else its data-original-url; anchors with neither are
    left out but counted. Rows are read each for itself, so pages without text or links have none.
    """
    found = pages.select(F.col(key), F.posexplode(markup.anchors(F.col(html))).alias("link_no", "a"))
    return found.select(
        key, "link_no", F.coalesce(F.nullif("a.href", F.lit("")), "a.original", "a.href").alias("href"),
        F.col("a.text").alias("link_text")).where("href is not null")


def link_candidates(links: DataFrame, cfg: Listing = Listing()) -> DataFrame:
    """Names from company links: from their text, else from their address."""
    found = _with_value(
        links.select("card_id", F.col("link_no").cast("long").alias("ord"), "href", "link_text"),
        "slug", lt.company_slug(F.col("href"), cfg))
    found = _with_once(found, "_tidy", lt.tidy(F.col("link_text")))
    options = F.array(
        F.struct(F.lit(LINK_TEXT).alias("priority"), lt.if_text(F.col("_tidy")).alias("name")),
        F.struct(F.lit(LINK_SLUG).alias("priority"), lt.name_of_slug(F.col("slug")).alias("name")))
    return found.select("card_id", "ord", F.explode(options).alias("o")).select(
        "card_id", "o.priority", "ord", "o.name").where(lt.is_company_name(F.col("name")))


def detail_candidates(links: DataFrame, blocks: DataFrame, cfg: Listing = Listing()) -> DataFrame:
    """Names from a detail panel: links of the company block, its text, then any link.

    ``links`` has card_id, link_no, href, link_text, in_block; ``blocks`` has card_id, text.
    """
    every = links.select(
        "card_id", F.lit(DETAIL).alias("priority"),
        (F.when(F.col("in_block"), 0).otherwise(1 << 32) + F.col("link_no")).cast("long").alias("ord"), "link_text", "href")
    for name, value in (
            ("_tidy", lt.tidy(F.col("link_text"))), ("_text", lt.if_text(F.col("_tidy"))),
            ("_by_text", lt.company_of_text(F.col("_text"))),
            ("_slug", lt.name_of_slug(lt.company_slug(F.col("href"), cfg)))):
        every = _with_once(every, name, value)
    slug = F.col("_slug")
    by_link = _with_value(every, "name", F.coalesce("_by_text", F.when(lt.is_company_name(slug), slug)))
    by_text = _with_company(blocks.select(
        "card_id", F.lit(DETAIL).alias("priority"), F.lit((1 << 32) - 1).cast("long").alias("ord"), "text"), F.col("text"))
    columns = ["card_id", "priority", "ord", "name"]
    return by_link.select(*columns).unionByName(by_text.select(*columns))


def text_candidates(texts: DataFrame, priority: int) -> DataFrame:
    """Names from element texts (card_id, ord, text) of one kind of place."""
    text = F.col("text")
    if priority == PRIMARY:
        text = F.split(text, "\n")[0]
    rows = texts.select(
        "card_id", F.lit(priority).alias("priority"), F.col("ord").cast("long").alias("ord"), text.alias("_raw"))
    return _with_company(rows, F.col("_raw")).drop("_raw")


def best_candidate(*candidates: DataFrame) -> DataFrame:
    """Per card the first name in the order of trust, then of appearance."""
    every = reduce(DataFrame.unionByName, candidates)
    best = first_per_key(every, ["card_id"], ["priority", "ord", "name"])
    return best.select("card_id", F.col("name").alias("company_name"), "priority")


def distinct_cards(*sources: DataFrame) -> DataFrame:
    """Cards of several discovery sources, each once, from the first source that has it."""
    numbered = [s.select("card_id", "ord", F.lit(i).alias("source_no")) for i, s in enumerate(sources)]
    return first_per_key(reduce(DataFrame.unionByName, numbered), ["card_id"], ["source_no", "ord"])


def session_stats(labelled: DataFrame, session: str = "session_id") -> DataFrame:
    return labelled.groupBy(session).agg(
        F.count(F.lit(1)).alias("jobs_scanned"),
        F.count_if("sponsors_h1b").alias("sponsors_found"))

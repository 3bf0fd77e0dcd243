"""Ranked search: for every query the employers whose name contains it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from ..operators.containment import best_containing
from ..operators.materialize import materialize


def search(
    queries: DataFrame,
    employers: DataFrame,
    limit: int = 5,
    query: str = "q",
    key: str = "query_id",
    literal: bool = False,
) -> DataFrame:
    """Up to ``limit`` employers per query row, best partial ratio first.

    Ties go to the larger filer, then by name. ``total`` is the number of rows returned for
    the query, not of all matches.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    keyed = queries.select(key, text.employer_name(F.col(query)).alias("name")).where(
        "name is not null")
    distinct = materialize(keyed.select("name").distinct(), "search")
    best = best_containing(distinct, employers, limit, scored=True, literal=literal)
    # At most ``limit`` rows per name.
    total = F.count(F.lit(1)).over(Window.partitionBy("name"))
    best = best.withColumn("total", total)
    return keyed.join(best, "name").select(
        key, "place", "employer_name", F.col("total_h1b_certified").alias("h1b_count"),
        "score", "total")

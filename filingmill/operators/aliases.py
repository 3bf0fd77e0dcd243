"""Curated aliases and how they override the derived ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import CURATED_ALIAS
from ..functions import coerce, text
from .intake import first_per_key

ALIAS_COLUMNS = ("primary_employer_name", "alias_name", "alias_type", "usage_count")


def curated_aliases(raw: DataFrame, line: str = "line_no") -> DataFrame:
    """Normalised curated rows; the last line of an alias wins."""
    named = raw.select(
        text.employer_name(F.col("primary_employer_name")).alias("primary_employer_name"),
        text.employer_name(F.col("alias_name")).alias("alias_name"),
        text.strip(
            F.coalesce(text.blank_to_null(F.col("alias_type")), F.lit(CURATED_ALIAS))
        ).alias("alias_type"),
        F.coalesce(coerce.to_int(F.col("usage_count")).cast("long"), F.lit(0)).alias("usage_count"),
        line,
    ).where("primary_employer_name is not null and alias_name is not null")
    return first_per_key(named, ["alias_name"], [F.desc(line)]).select(*ALIAS_COLUMNS)


def merge_curated(auto: DataFrame, curated: DataFrame) -> DataFrame:
    """Curated rows plus the derived ones whose name is not curated.

    The derived name is normalised once more for the comparison: a doubled suffix period
    loses its second one only then. Spark broadcasts the curated side only while its
    measured size allows it.
    """
    again = auto.withColumn("_key", text.employer_name(F.col("alias_name")))
    kept = again.join(
        curated.select(F.col("alias_name").alias("_key")), "_key", "left_anti"
    ).drop("_key")
    return curated.select(*ALIAS_COLUMNS).unionByName(kept.select(*ALIAS_COLUMNS))


def replace_scope(stored: DataFrame, fresh: DataFrame, alias_type: str = CURATED_ALIAS) -> DataFrame:
    """Swap all rows of one alias type for a fresh set and leave the other types alone."""
    others = stored.where(~F.col("alias_type").eqNullSafe(alias_type))
    return others.unionByName(fresh.withColumn("alias_type", F.lit(alias_type)))

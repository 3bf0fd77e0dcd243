"""Keeping stored tables current: typed loads, upserts and vector write-back.

Every operator returns the new snapshot of a table; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, functions as F, types as T

from ..config import AUTO_ALIAS, Embedding
from ..functions import coerce

EMPLOYER_VALUES = (
    "total_h1b_certified", "earliest_decision_date", "latest_decision_date",
    "last_active_year", "h1b_dependent", "last_updated",
)


def typed_employers(rows: DataFrame, run_ts: datetime) -> DataFrame:
    """All-text employer rows with their types; rows without a name are left out."""
    return rows.select(
        coerce.to_text(F.col("employer_name")).alias("employer_name"),
        F.coalesce(coerce.to_int(F.col("total_h1b_certified")), F.lit(0)).alias("total_h1b_certified"),
        coerce.to_date(F.col("earliest_decision_date")).alias("earliest_decision_date"),
        coerce.to_date(F.col("latest_decision_date")).alias("latest_decision_date"),
        coerce.to_int(F.col("last_active_year")).alias("last_active_year"),
        coerce.to_bool(F.col("h1b_dependent")).alias("h1b_dependent"),
        F.lit(run_ts).alias("last_updated"),
    ).dropna(subset=["employer_name"])


def typed_job_levels(rows: DataFrame) -> DataFrame:
    counts = [f"level_{i}_count" for i in range(1, 5)] + ["total_count"]
    shares = [f"level_{i}_pct" for i in range(1, 5)]
    return rows.select(
        *[coerce.to_text(F.col(c)).alias(c)
          for c in ("employer_name", "normalized_job_title", "soc_code")],
        *[F.coalesce(coerce.to_int(F.col(c)), F.lit(0)).alias(c) for c in counts],
        *[coerce.to_float(F.col(c)).cast(T.DecimalType(5, 2)).alias(c) for c in shares],
    ).dropna(subset=["employer_name"])


def typed_aliases(rows: DataFrame) -> DataFrame:
    return rows.select(
        coerce.to_text(F.col("primary_employer_name")).alias("primary_employer_name"),
        coerce.to_text(F.col("alias_name")).alias("alias_name"),
        F.coalesce(coerce.to_text(F.col("alias_type")), F.lit(AUTO_ALIAS)).alias("alias_type"),
        F.coalesce(coerce.to_int(F.col("usage_count")), F.lit(0)).alias("usage_count"),
    ).dropna(subset=["primary_employer_name", "alias_name"])


def upsert(
    stored: DataFrame,
    fresh: DataFrame,
    key: str = "employer_name",
    replace: Sequence[str] = EMPLOYER_VALUES,
    prune: bool = False,
) -> DataFrame:
    """Fresh rows overwrite ``replace`` on stored rows with the same key, or are added.

    All other stored columns (vectors, ids) are kept, and so are stored rows without a fresh
    one unless ``prune`` is set. The key is unique on both sides, so the join cannot fan out.
    """
    is_fresh = F.col("_fresh").isNotNull()
    new = fresh.select(
        F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in replace],
        F.lit(1).alias("_fresh"))
    joined = stored.join(new, stored[key] == new["_key"], "right" if prune else "full")
    return joined.select(*[
        F.coalesce(F.col(key), F.col("_key")).alias(c) if c == key
        else F.when(is_fresh, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in replace
        else F.col(c)
        for c in stored.columns
    ])


def valid_vector(vector, dim: int):
    """The vector, or NULL when its length is wrong."""
    return F.when(F.size(vector) == dim, vector)


def write_back_vectors(stored: DataFrame, vectors: DataFrame, dim: int, key: str = "id") -> DataFrame:
    """Put new vectors where none is stored; wrong lengths and NULLs are skipped."""
    new = vectors.select(key, valid_vector(F.col("embedding"), dim).alias("_new"))
    return stored.join(new, key, "left").select(*[
        F.coalesce("embedding", "_new").alias("embedding") if c == "embedding" else c
        for c in stored.columns
    ])


def with_vector_column(stored: DataFrame) -> DataFrame:
    """Add an empty ``embedding`` column to tables that predate it."""
    if "embedding" in stored.columns:
        return stored
    return stored.withColumn("embedding", F.lit(None).cast(T.ArrayType(T.FloatType())))


def coverage(employers: DataFrame, cfg: Embedding = Embedding()) -> DataFrame:
    """Employers in total, without and with a vector, and what filling the rest may cost."""
    pending = F.count_if(F.col("embedding").isNull())
    tokens = pending * cfg.tokens_per_name
    return employers.agg(
        F.count(F.lit(1)).alias("total"),
        pending.alias("pending"),
        F.count_if(F.col("embedding").isNotNull()).alias("done"),
        tokens.alias("estimated_tokens"),
        (tokens / 1_000_000 * cfg.usd_per_million_tokens).alias("estimated_cost_usd"),
    )


def pending(employers: DataFrame, limit: int | None = None) -> DataFrame:
    """Employers without a vector; with ``limit``, the first ones by id, or by name without ids."""
    key = ["id"] if "id" in employers.columns else []
    waiting = employers.where(F.col("embedding").isNull()).select(*key, "employer_name")
    return waiting if limit is None else waiting.orderBy(*key, "employer_name").limit(limit)

"""From ranked neighbours to one answer: near-tie ordering, threshold, ambiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import Semantic
from ..functions.vectors import volume_score


def rerank(neighbours: DataFrame, cfg: Semantic = Semantic(), key: str = "query_id") -> DataFrame:
    """Order near-ties by filing volume.

    When the two best are closer than ``tight_gap``, the highest volume-weighted similarity
    among the first ``rerank_window`` above the floor moves to the front, if it reaches the
    threshold. ``neighbours`` holds at most ``fetch_k`` rows per key, so the list built
    here is short. Returns the rows with their new ``place``.
    """
    row = F.struct("place", "employer_name", "total_h1b_certified", "similarity")
    ranked = neighbours.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("c"))
    c = F.col("c")
    s0, s1 = F.try_element_at(c, F.lit(1))["similarity"], F.try_element_at(c, F.lit(2))["similarity"]
    floor = F.greatest(
        F.lit(cfg.threshold - cfg.floor_below_threshold),
        F.least(s0, s1) - cfg.floor_below_runner_up)
    pool = F.filter(F.slice(c, 1, cfg.rerank_window), lambda x: x["similarity"] >= floor)
    # Highest score first, then the earlier place.
    best = F.array_max(F.transform(pool, lambda x: F.named_struct(
        F.lit("score"), volume_score(x["similarity"], x["total_h1b_certified"]),
        F.lit("neg"), -x["place"],
        F.lit("similarity"), x["similarity"])))
    moves = (
        (F.size(c) >= 2) & (s0 - s1 < cfg.tight_gap)
        & (F.size(pool) >= 2) & (best["similarity"] >= cfg.threshold))
    chosen = F.when(moves, -best["neg"]).otherwise(F.lit(1))
    old = F.col("x.place")
    place = (
        F.when(old == F.col("chosen"), 1)
        .when(old < F.col("chosen"), old + 1)
        .otherwise(old))
    return ranked.select(key, chosen.alias("chosen"), F.explode("c").alias("x")).select(
        key, "x.employer_name", "x.total_h1b_certified", "x.similarity",
        place.cast("int").alias("place"))


def decide(neighbours: DataFrame, cfg: Semantic = Semantic(), key: str = "query_id") -> DataFrame:
    """One row per key: the best name and its confidence, or no name.

    Reordering near-ties cannot change this outcome, since near-ties are refused either way,
    so plain neighbours and reranked ones give the same answer.
    """
    def at(place: int, column: str):
        return F.max(F.when(F.col("place") == place, F.col(column)))

    top = neighbours.where("place <= 2").groupBy(key).agg(
        at(1, "similarity").alias("s0"), at(2, "similarity").alias("s1"),
        at(1, "employer_name").alias("employer_name"))
    margin = F.col("s0") - F.col("s1")
    accepted = (F.col("s0") >= cfg.threshold) & (margin.isNull() | (margin >= cfg.tight_gap))
    damped = F.when(margin < cfg.ambiguous_margin, F.col("s0") * cfg.damping).otherwise(F.col("s0"))
    return top.select(
        key,
        F.when(accepted, F.col("employer_name")).alias("employer_name"),
        F.when(accepted, damped).alias("confidence"))

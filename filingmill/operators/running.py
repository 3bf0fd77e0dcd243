"""Row numbers and running totals over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import prefix
from .materialize import materialize


def _running(df: DataFrame, order: str, sums: dict[str, Column], span: int | None) -> DataFrame:
    """Running sums along ``order``, in ranges of rows or in spans of its values."""
    if span is not None:
        return prefix.running_sum(df, [], F.floor(F.col(order) / span), [order], sums)
    return prefix.running_sum(prefix.ranged(df, order), [], F.col("_range"), [order], sums).drop("_range")


def batches(df: DataFrame, order: str, size: int, span: int | None = None) -> DataFrame:
    """Number rows along a unique integer and put every ``size`` of them into one batch."""
    numbered = _running(df, order, {"row_no": F.lit(1).cast("long")}, span)
    return numbered.withColumn(
        "batch_no", (F.floor((F.col("row_no") - 1) / size) + 1).cast("long"))


def batch_progress(
    batched: DataFrame, tokens: Column, usd_per_million: float, span: int | None = None
) -> DataFrame:
    """Rows, tokens and cost per batch with running totals."""
    per_batch = batched.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(tokens).alias("tokens"))
    total = _running(
        per_batch, "batch_no", {"rows_so_far": F.col("rows"), "tokens_so_far": F.col("tokens")}, span)
    return total.withColumn(
        "cost_so_far_usd", F.col("tokens_so_far") / 1_000_000 * usd_per_million)


def placed(ordered: DataFrame) -> DataFrame:
    """A sorted table with every row's ``place`` in its order, from 1.

    Ids rise along the tasks of a sort and along the rows of a task, so a task's rows are one chunk.
    """
    numbered = materialize(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    chunk = F.shiftright("_id", 33)
    return prefix.running_sum(numbered, [], chunk, ["_id"], {"place": F.lit(1).cast("long")}).drop("_id")

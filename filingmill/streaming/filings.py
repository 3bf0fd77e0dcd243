"""Filings that arrive file by file, in any order; the best copy of a case counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import FILE_ORDER
from ..operators.intake import clean_cases, first_per_key
from .batches import Batches


def intake_stream(
    raw: DataFrame,
    store: str,
    checkpoint: str,
    order: Sequence[str] = FILE_ORDER,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append the cases of each batch with the columns that order them.

    A batch reads nothing of the store, so its cost follows its own size; merges keep the best
    copy of a case. A batch that is run again overwrites its own segment.
    """
    kept = _stored(raw.sparkSession, store, order)

    def add(batch: DataFrame, batch_id: int) -> None:
        kept.write(clean_cases(batch, order, keep=order), batch_id)

    return (raw.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stored_cases(spark: SparkSession, store: str, order: Sequence[str] = FILE_ORDER) -> DataFrame:
    """One row per case of all batches: the earliest file and row win, whenever they came."""
    rows = _stored(spark, store, order).read()
    if rows is None:
        raise FileNotFoundError(f"no batch in {store}")
    return first_per_key(rows, ["case_number"], order).drop(*order)


def _stored(spark: SparkSession, store: str, order: Sequence[str]) -> Batches:
    return Batches(spark, store, lambda rows: first_per_key(rows, ["case_number"], order))

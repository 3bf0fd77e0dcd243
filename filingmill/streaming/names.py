"""Resolving names as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text
from ..operators.containment import piece_index
from ..operators.materialize import temporary
from ..plans.resolve import Memory, one_alias, records, resolve


def match_known(names: DataFrame, employers: DataFrame, aliases: DataFrame, raw_name: str = "raw_name") -> DataFrame:
    """The exact and alias layers as stream-static joins; other names have no match type."""
    name = text.employer_name(F.col(raw_name))
    direct = records(employers).select(F.struct("*").alias("_direct"), F.col("employer_name").alias("_exact"))
    hop = one_alias(aliases).join(
        records(employers), F.col("primary_employer_name") == F.col("employer_name")
    ).select(F.struct(*records(employers).columns).alias("_hop"), F.col("alias_name").alias("_alias"))
    joined = (
        names.withColumn("normalized_name", name)
        .join(direct, F.col("normalized_name") == F.col("_exact"), "left")
        .join(hop, F.col("normalized_name") == F.col("_alias"), "left"))
    kind = (
        F.when(F.col("normalized_name").isNull(), "invalid_input")
        .when(F.col("_exact").isNotNull(), "exact")
        .when(F.col("_alias").isNotNull(), "alias"))
    return joined.select(
        *names.columns, "normalized_name", kind.alias("match_type"),
        F.coalesce("_direct", "_hop").alias("record")
    ).select("*", "record.*").drop("record")


def resolve_stream(
    names: DataFrame,
    employers: DataFrame,
    aliases: DataFrame,
    out: str,
    checkpoint: str,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """All layers for every micro-batch, written below ``out`` by batch.

    A batch that is run again after a failure overwrites its own folder. Intermediate
    tables of a batch are deleted when it is written. The pieces of the employers' names are cut
    once, before the first batch; names that an earlier batch asked for are answered from what was
    written then, in ``memory``.
    """
    index = piece_index(employers)
    memory = Memory(names.sparkSession, f"{out.rstrip('/')}-answers", "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        with temporary(batch.sparkSession):
            resolve(batch, employers, aliases, index=index, memory=memory, batch=batch_id, **options).write.mode(
                "overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (names.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())

"""Work along the order of a key, split so that no key has to fit one task.

A plain window hands all rows of a key to one task. Here a key is also cut into chunks along
its order; chunks run in parallel, and what each one carries over is worked out on one row
per key and chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .materialize import materialize


def along(
    df: DataFrame,
    by: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    inside: Callable[[WindowSpec], Sequence[dict[str, Column]]],
    totals: dict[str, Column],
    carry: Callable[[WindowSpec], Sequence[dict[str, Column]]],
) -> DataFrame:
    """Add columns worked out inside each chunk, and ones carried from the chunks before.

    ``inside`` gets the window of a row's chunk in order, ``totals`` are aggregates of the
    chunk over the input and the first ``inside`` columns, ``carry`` gets the window of a
    key's chunks. Both functions return layers of columns; a layer can use the ones before.
    ``chunk`` must not decrease along ``order``.
    """
    # Never NULL, so that joining on them adds no filter; one struct, so that NULL keys meet.
    cut = df.withColumn("_key", F.struct(*by) if by else F.lit(0)).withColumn(
        "_chunk", F.coalesce(chunk, F.lit(0)))
    for layer in inside(Window.partitionBy("_key", "_chunk").orderBy(*order)):
        cut = cut.withColumns(layer)
    chunks = cut.groupBy("_key", "_chunk").agg(*[v.alias(n) for n, v in totals.items()])
    for layer in carry(Window.partitionBy("_key").orderBy("_chunk")):
        chunks = chunks.withColumns(layer)
    return cut.join(chunks, ["_key", "_chunk"]).drop("_key", "_chunk")


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in ranges of ``order`` of about equal size, numbered in ``_range``.

    Ranges follow the rows and not the values, so neither sparse ids nor busy times make chunks
    too many or too large. Written once, since another run would cut the ranges elsewhere.
    """
    cut = df.repartitionByRange(*[F.col(c) for c in order])
    return materialize(cut.withColumn("_range", F.spark_partition_id()), "ranges")


def so_far(window: WindowSpec) -> WindowSpec:
    """Rows up to and including the current one."""
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(window: WindowSpec) -> WindowSpec:
    """Rows before the current one."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, by: Sequence[str], chunk: Column, order: Sequence[str],
                sums: dict[str, Column]) -> DataFrame:
    """Running sums over the rows of a key up to and including each row."""
    zero = F.lit(0)
    out = along(
        df, by, chunk, order,
        lambda w: [{f"_v_{n}": v for n, v in sums.items()},
                   {f"_in_{n}": F.coalesce(F.sum(f"_v_{n}").over(so_far(w)), zero) for n in sums}],
        {f"_t_{n}": F.sum(f"_v_{n}") for n in sums},
        lambda w: [{f"_b_{n}": F.coalesce(F.sum(f"_t_{n}").over(before(w)), zero) for n in sums}])
    return out.select(*df.columns, *[(F.col(f"_in_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])

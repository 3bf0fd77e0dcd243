"""A table by key that runs change, each writing only the rows it changes.

The columns beside the key form parts that change together, such as an employer's figures and its
vector. A run writes its rows as a segment, with its number on every part it gives; the newest
number of each part of a key counts. Segments are merged as they grow in number, by the same rule,
so a run costs what it changes and, now and then, a merge of runs of its size. A segment counts
once it is finished, so a failed run changes nothing, and a run that is repeated replaces itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..streaming.batches import FAN, Batches


class StoredTable:
    """``parts`` names the columns of every part; a part is absent where all its columns are NULL."""

    def __init__(
        self, spark: SparkSession, folder: str, key: str, parts: Mapping[str, Sequence[str]], fan: int = FAN,
    ) -> None:
        self.key, self.parts = key, {n: list(c) for n, c in parts.items()}
        self.runs = Batches(spark, folder, self._newest, fan)

    def _newest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(*[
            column for n in self.parts for column in (
                F.max_by(n, f"{n}_run").alias(n), F.max(f"{n}_run").alias(f"{n}_run"))])

    def upsert(self, rows: DataFrame, run: int | None = None) -> int:
        """Write the parts that ``rows`` has columns of, unique by key, as a run; the next one, unless numbered.

        Rows without a key are left out. Parts that a row does not have stay as they were.
        """
        last = self.runs.last()
        run = run if run is not None else 0 if last is None else last + 1
        columns = []
        for n, names in self.parts.items():
            if not set(names) <= set(rows.columns):
                # Taken from an earlier run's types where the rows have none of the part.
                before = self.runs.read()
                if before is None:
                    raise ValueError(f"the first run needs {names}")
                columns += [F.lit(None).cast(before.schema[n].dataType).alias(n), F.lit(None).cast("long").alias(f"{n}_run")]
                continue
            there = reduce(Column.__or__, [F.col(c).isNotNull() for c in names])
            columns += [F.when(there, F.struct(*names)).alias(n), F.when(there, F.lit(run)).cast("long").alias(f"{n}_run")]
        self.runs.write(rows.where(F.col(self.key).isNotNull()).select(self.key, *columns), run)
        return run

    def read(self, below: int | None = None) -> DataFrame | None:
        """The table as it is now, or was before run ``below``; None before the first run."""
        rows = self.runs.read(below)
        if rows is None:
            return None
        return self._newest(rows).select(self.key, *[
            F.col(n)[c].alias(c) for n, names in self.parts.items() for c in names])

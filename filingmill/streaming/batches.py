"""Tables that a stream writes batch by batch, merged as they grow.

Every batch is a segment of its own, written into a folder named after it and overwritten when the
batch is run again. When the last of ``FAN`` batches is written, their segments are merged into
one; likewise of ``FAN`` such segments, and so on, so the number of segments follows the logarithm
of the number of batches. A segment counts once its write has finished; readers take the longest
finished segments, so they see the same rows before, during and after a merge. Segments that a
merge has replaced are deleted when the next larger merge is done, so running readers keep them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FAN = 8


class Batches:
    """A table of segments below a folder that all executors reach.

    ``reduce`` brings the rows of several segments together when they are merged; by default all
    rows stay. It must not matter how often and in which groups it is applied.
    """

    def __init__(
        self, spark: SparkSession, folder: str, reduce: Callable[[DataFrame], DataFrame] | None = None, fan: int = FAN,
    ) -> None:
        self.spark, self.folder, self.fan = spark, folder.rstrip("/"), fan
        self.reduce = reduce or (lambda rows: rows)

    def _fs(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def finished(self) -> list[tuple[int, int]]:
        """First and last batch of every finished segment."""
        fs, pattern = self._fs(f"{self.folder}/*-*/_SUCCESS")
        names = [s.getPath().getParent().getName() for s in fs.globStatus(pattern) or []]
        return sorted(tuple(int(n) for n in name.split("-")) for name in names)

    def segments(self, below: int | None = None) -> list[tuple[int, int]]:
        """The longest finished segments that together hold all batches, or those before ``below``."""
        out: list[tuple[int, int]] = []
        for first, last in sorted(self.finished(), key=lambda s: (s[0], -s[1])):
            if (below is None or last < below) and (not out or first > out[-1][1]):
                out.append((first, last))
        return out

    def read(self, below: int | None = None, schema=None) -> DataFrame | None:
        """All rows of the batches, or of those before ``below``; None before the first."""
        found = self.segments(below)
        if not found:
            return None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.folder}/{a}-{b}" for a, b in found])

    def last(self, below: int | None = None) -> int | None:
        """The newest batch, or the newest before ``below``."""
        found = self.segments(below)
        return found[-1][1] if found else None

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch and merge what it completes."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{batch_id}-{batch_id}")
        size = self.fan
        while (batch_id + 1) % size == 0:
            self._merge(batch_id + 1 - size, batch_id, size)
            size *= self.fan

    def _merge(self, first: int, last: int, size: int) -> None:
        inside = [s for s in self.finished() if first <= s[0] and s[1] <= last and s != (first, last)]
        parts, at = [], first
        for a, b in sorted(inside, key=lambda s: (s[0], -s[1])):
            if a >= at:
                parts.append((a, b))
                at = b + 1
        rows = self.spark.read.parquet(*[f"{self.folder}/{a}-{b}" for a, b in parts])
        self.reduce(rows).write.mode("overwrite").parquet(f"{self.folder}/{first}-{last}")
        for a, b in inside:
            # One generation of replaced segments stays for readers that have begun.
            if (b - a + 1) * self.fan * self.fan <= size:
                self.delete(a, b)

    def delete(self, first: int, last: int) -> None:
        fs, path = self._fs(f"{self.folder}/{first}-{last}")
        fs.delete(path, True)

"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ASCII white space, the separators of words in every contract here.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row and only when it is needed."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(spaced, " "), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def bounded_sample(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """At most ``bound`` rows, the same ones at every partitioning: smallest key hashes first.

    A large table is first cut by a limit on the hash to about four times the bound, so that
    only these rows meet, however many tasks there are. ``df`` is read twice.
    """
    share = 4 * bound / max(1, df.count())
    place = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40))
    few = df.where(place < int(share * (1 << 40))) if share < 1 else df
    return few.orderBy(place, key).limit(bound)


def long_table(values: list[int]) -> Column:
    """A constant array of longs; Spark folds it to one literal shared by all rows."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def text_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches of whole texts small: a batch is bounded by rows, not by bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most so many rows; Spark bounds their bytes."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, list[bytes]]:
    """Texts cut at ASCII white space: ends of the texts' chunks, places of all chunks among the distinct ones, these.

    Null texts have no chunks; a chunk may be empty.
    """
    words = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = words.values.dictionary_encode()
    return words.offsets.to_numpy(), coded.indices, coded.dictionary.cast(pa.binary()).to_pylist()


def gathered(values: list[bytes], places: pa.Array, ends: np.ndarray) -> Iterator[bytes]:
    """For every text the values of its chunks, one after the other."""
    taken = pa.array(values, pa.large_binary()).take(places)
    cut = np.frombuffer(taken.buffers()[1], np.int64)[ends].tolist()
    data = memoryview(taken.buffers()[2] or b"")
    for a, b in zip(cut, cut[1:]):
        yield bytes(data[a:b])


def worker_store(name: str) -> dict:
    """A dictionary of this Python process that outlives a task, as Spark reuses workers."""
    module = sys.modules.setdefault("filingmill_worker_store", types.ModuleType("filingmill_worker_store"))
    return module.__dict__.setdefault(name, {})


class Generations:
    """A bounded cache: what is asked for moves to the young generation, the old one is let go."""

    def __init__(self, limit: int) -> None:
        self.limit, self.young, self.old = limit, {}, {}

    def turn(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.young[key] = value
        return value


def worker_cache(name: str, limit: int) -> Generations:
    """The cache of that name of this Python process, ready for another batch."""
    cache = worker_store(name).setdefault("cache", Generations(limit))
    cache.turn()
    return cache

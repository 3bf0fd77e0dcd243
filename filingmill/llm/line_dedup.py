"""Line dedup: lines that many documents share stay in one of them only.

Each distinct (document, line key) pair becomes one row of two hashes; the documents of a key
are counted after map-side combining, so a line that a third of all documents hold is one row
per task. The pairs meet the few keys over the threshold in an equi-join on the hashes, which
adaptive execution splits or broadcasts, and the dropped keys of a document travel to its text
as one small array. Texts are shuffled once, by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import BLANKS, ascii_lower, text_batches

_SEED = 42  # of Spark's xxhash64


def line_key(line):
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dropped_keys(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, keys): per document the hash pairs of the line keys it loses.

    ``docs`` has ``doc_id`` and ``text``. Keys shorter than ``min_chars`` never count.
    """
    lines = docs.where("doc_id is not null").select(
        "doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    keys = lines.select("doc_id", line_key(F.col("line")).alias("key")).where(
        F.char_length("key") >= min_chars)
    pairs = keys.select("doc_id", F.xxhash64("key").alias("h1"), F.xxhash64("key", "key").alias("h2")).distinct()
    shared = (
        pairs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "holder"))
    lost = pairs.join(shared, ["h1", "h2"]).where(F.col("doc_id") != F.col("holder"))
    return lost.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _kept(text: str | None, lost: list | None) -> tuple[str, int, int]:
    lines = (text or "").split("\n")
    if not lost:
        return text or "", len(lines), 0
    gone = {(k["h1"], k["h2"]) for k in lost}
    kept = []
    for line in lines:
        # bytes.lower() changes A-Z only, as the key asks.
        key = line.encode().strip(BLANKS.encode()).lower()
        h1 = xxhash.xxh64_intdigest(key, _SEED)
        if (_signed(h1), _signed(xxhash.xxh64_intdigest(key, h1))) not in gone:
            kept.append(line)
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Every row of ``docs`` as (row, kept, n_lines, n_dropped); ``row`` is the row itself.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` documents loses
    all its lines except in the document with the largest doc_id; there all copies stay.
    Null and empty texts are one empty line and stay. Rows without a doc_id keep their lines and
    count for no key. Rows that repeat a doc_id are one document: they lose the same keys.
    Other columns may have any names.
    """
    text_batches(docs.sparkSession)
    lost = dropped_keys(docs.select("doc_id", "text"), min_chars, min_docs)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"))
    joined = rows.join(lost.withColumnRenamed("doc_id", "_id"), "_id", "left").select("row", "keys")
    schema = StructType([
        joined.schema["row"], StructField("kept", StringType()),
        StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            done = [_kept(t, k) for t, k in zip(row.field("text").to_pylist(), batch.column(1).to_pylist())]
            text, n, gone = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                names=["row", "kept", "n_lines", "n_dropped"])

    return joined.mapInArrow(reassemble, schema)


def without_shared_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with shared lines gone from ``text``; ``n_chars``, if there, counts the new text."""
    done = drop_shared_lines(docs, **settings)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(
            F.col("n_dropped") > 0, F.char_length("kept").cast(docs.schema["n_chars"].dataType)
        ).otherwise(F.col("row.n_chars"))
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

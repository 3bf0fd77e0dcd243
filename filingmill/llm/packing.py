"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Two documents of one source, or of one cluster of duplicates, never share a bin. Each bin carries
a bitmap of its sources and clusters. Bins are ordered by what is left in them; a tree over that
order holds in each node the bits that all bins below have in common, so the search for the
tightest bin steps over whole stretches of bins that all conflict, and goes on to the next larger
residual until a bin that is large enough and compatible is found, or a new one is opened.

Documents are dealt by a hash of their id into shards of a few thousand, each packed on its own in
descending order of length, so no task sees more than a shard and bins of shards never meet.
Documents over the capacity are cut into full pieces and a rest.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.materialize import materialize
from .common import words_of

CAPACITY = 2048
PIECES_PER_SHARD = 2048
_RESULT = "doc_id long, piece int, n_tokens long, bin_id long, start long"


class Bins:
    """Open bins by residual, with the bits common to all bins of every stretch of residuals."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << max(0, capacity).bit_length()
        self.common = [-1] * (2 * self.width)  # no bin: all bits are common, nothing fits
        self.held: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # residual -> bin: bits

    def _update(self, residual: int) -> None:
        at, bits = self.width + residual, -1
        for own in self.held[residual].values():
            bits &= own
        self.common[at] = bits
        while at > 1:
            at >>= 1
            self.common[at] = self.common[2 * at] & self.common[2 * at + 1]

    def add(self, residual: int, number: int, bits: int) -> None:
        self.held[residual][number] = bits
        self._update(residual)

    def take(self, least: int, bits: int) -> tuple[int, int, int] | None:
        """The tightest bin with ``least`` left and none of ``bits``: (residual, number, its bits)."""
        def search(node: int, low: int, high: int) -> tuple[int, int, int] | None:
            if high < least or self.common[node] & bits:
                return None
            if low == high:
                fitting = [n for n, own in self.held[low].items() if not own & bits] if low < len(self.held) else []
                return (low, min(fitting), 0) if fitting else None
            half = (low + high) // 2
            return search(2 * node, low, half) or search(2 * node + 1, half + 1, high)

        found = search(1, 0, self.width - 1)
        if not found:
            return None
        residual, number, _ = found
        own = self.held[residual].pop(number)
        self._update(residual)
        return residual, number, own


def pack_shard(items: list[tuple], capacity: int) -> list[tuple[int | None, int | None]]:
    """(bin, start) of each (doc_id, piece, n_tokens, source, cluster); none for empty pieces."""
    def bits_of(column: int) -> dict:
        again = [k for k, n in Counter(i[column] for i in items).items() if n > 1 and k is not None]
        return {k: i for i, k in enumerate(sorted(again))}

    sources, clusters = bits_of(3), bits_of(4)
    bins, opened = Bins(capacity), 0
    out: list[tuple[int | None, int | None]] = [(None, None)] * len(items)
    order = sorted(range(len(items)), key=lambda i: (
        -items[i][2], items[i][0] is None, items[i][0] or 0, items[i][1], i))
    for i in order:
        n, source, cluster = items[i][2:5]
        if not n:
            continue
        bits = (1 << sources[source] if source in sources else 0)
        bits |= 1 << (len(sources) + clusters[cluster]) if cluster in clusters else 0
        found = bins.take(n, bits)
        if not found:
            found, opened = (capacity, opened, 0), opened + 1
        residual, number, own = found
        out[i] = (number, capacity - residual)
        bins.add(residual - n, number, own | bits)
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, pieces_per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, start): every piece of every document in its bin.

    ``items`` has doc_id, n_tokens, source and cluster. A document of more than ``capacity``
    tokens is cut; documents without tokens are one row without a bin. Null sources and clusters
    conflict with nothing. Ties go to the smaller id, then the smaller piece; equal residuals to
    the bin opened first. Repeated rows are packed as often as they occur.

    Pieces are dealt to shards by a hash of all that they are. Rows without an id, and those that
    repeat one, may be alike in all of it: they are told apart by a number written once.
    """
    pieces = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    rows = items.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "cluster", F.col("n_tokens").alias("total"),
        pieces.alias("pieces"), F.monotonically_increasing_id().alias("number"))
    rows = materialize(rows, "pieces")
    count = rows.agg(F.coalesce(F.sum("pieces"), F.lit(0))).first()[0]
    shards = max(1, -(-count // pieces_per_shard))
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(again, "doc_id", "left").withColumn(
        "number", F.when(F.col("doc_id").isNull() | F.col("n").isNotNull(), F.col("number")).otherwise(F.lit(0)))
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    dealt = cut.select(
        F.pmod(F.xxhash64("doc_id", "total", "source", "cluster", "number", "piece"), F.lit(shards)).cast("int").alias("shard"),
        "doc_id", "piece", F.least(
            F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("long").alias("n_tokens"), "source", "cluster")

    def packed(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("doc_id", "piece", "n_tokens", "source", "cluster")]
        placed = pack_shard(list(zip(*columns)), capacity)
        base = table.column("shard")[0].as_py() << 32
        return pa.table({
            "doc_id": table.column("doc_id"), "piece": table.column("piece"), "n_tokens": table.column("n_tokens"),
            "bin_id": pa.array([None if b is None else base + b for b, _ in placed], pa.int64()),
            "start": pa.array([s for _, s in placed], pa.int64())})

    return dealt.groupBy("shard").applyInArrow(packed, _RESULT)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, source, cluster) of ``docs``: words as tokens, equal word sequences as clusters."""
    words = words_of(F.lower("text"))
    return docs.select(
        "doc_id", "source", words.alias("words")).select(
        "doc_id", F.size("words").cast("long").alias("n_tokens"), "source",
        F.when(F.size("words") > 0, F.xxhash64("words")).alias("cluster"))

"""Near-duplicate classes by Order MinHash and banded alignment.

Words are runs of letters and digits, lower-cased; a k-mer is five of them, labelled with how many
equal ones stand before it, so that labelled k-mers are unique in a text. A sketch takes, for each
of several hash functions, the smallest labelled k-mers and keeps them in text order; two texts
meet where one such sequence is equal. That depends on content and order, as edits do.

Exact copies are one representative from the start. Members of a bucket are compared with its
smallest and its largest id only, so a bucket makes links in proportion to its members. Members of
buckets that fall into several classes meet again in the finer buckets of two equal sequences,
which pairs over the threshold share many of, and texts with one common passage hardly ever; there
only pairs of different classes are compared. What is then still of several classes is decided pair
by pair: a bucket is cut into blocks, every two blocks are one row, and a pair of different classes
is passed on unless its parity bitmaps differ in more bits than the threshold lets k-mers differ.
That is a true bound, so no pair over the threshold that shares a key is left out.

A candidate pair is verified by aligning the two sequences of labelled k-mers. As these are unique,
the best alignment is the longest increasing run of matched places. A pair over the threshold never
strays from the diagonal by more than the k-mers it may leave unmatched, which is the band. The
similarity is aligned k-mers over all k-mers of both, i.e. the Jaccard similarity of five-word
shingles that stand in the same order.

Classes are connected components over the verified links, found by passing on smallest ids and
jumping along them; every round is a written table.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.materialize import materialize
from .common import text_batches

K = 5
TAKEN = 4
SKETCHES = 20
THRESHOLD = 0.8
# Members of a block of a bucket, on average; bits of a parity bitmap at most.
BLOCK, BITS = 512, 1 << 14
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def labelled_kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the labelled k-mers in text order; a shorter text is one k-mer."""
    words = words.view(np.uint64)
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = _mixed(h * _ODD + words[j:j + n])
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]]
    if not new.all():
        place = np.arange(n)
        count = np.empty(n, np.uint64)
        count[order] = place - np.maximum.accumulate(np.where(new, place, 0))
        h = np.where(count > 0, _mixed(h + count * _ODD), h)
    return h


def sketch(kmers: np.ndarray) -> np.ndarray:
    """One key for each hash function: its smallest k-mers, in text order."""
    n = min(TAKEN, len(kmers))
    out = np.empty(SKETCHES, np.uint64)
    step = max(1, (1 << 20) // len(kmers))
    for a in range(0, SKETCHES, step):
        seeds = _SEEDS[a:a + step, None]
        ranks = _mixed(_mixed(kmers[None, :] ^ seeds) + seeds)
        chosen = np.argpartition(ranks, n - 1, axis=1)[:, :n] if n < len(kmers) else np.tile(np.arange(n), (len(seeds), 1))
        chosen.sort(axis=1)
        key = seeds[:, 0] + np.uint64(n)
        for j in range(n):
            key = _mixed(key * _ODD + kmers[chosen[:, j]])
        out[a:a + step] = key
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned over all k-mers of two labelled sequences; 0 where it can't reach the threshold."""
    total = len(a) + len(b)
    need = math.ceil(threshold / (1 + threshold) * total - 1e-9)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not total or len(i) < need:
        return 0.0
    order = np.argsort(i)
    i, j = i[order], j[order]
    j = j[np.abs(i - j) <= total - 2 * need]
    if len(j) > 1 and (np.diff(j) < 0).any():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at:at + 1] = [x]
        aligned = len(tails)
    else:
        aligned = len(j)
    return aligned / (total - aligned) if aligned >= need else 0.0


def parity_bits(kmers: np.ndarray) -> np.ndarray:
    """Per bit whether an odd number of k-mers falls there; halves xored are the bitmap of half the size."""
    size = min(BITS, max(64, 1 << (2 * len(kmers) - 1).bit_length()))
    at = (kmers & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def close_pairs(ids: np.ndarray, roots: np.ndarray, own: np.ndarray, n: np.ndarray, bits: list[np.ndarray],
                threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids with different roots that may reach the threshold.

    With two blocks in ``own`` only pairs across them. Different bits are different k-mers at least.
    """
    width = np.array([len(b) for b in bits])
    matrices = {w: np.stack([bits[i] for i in np.flatnonzero(width == w)]) for w in np.unique(width).tolist()}
    two, left, right = own.min() < own.max(), [], []
    for w in matrices:
        for v in matrices:
            if v < w:
                continue
            a, b = np.flatnonzero(width == w), np.flatnonzero(width == v)
            x, y = matrices[w], matrices[v]
            while y.shape[1] > w:
                y = y[:, :y.shape[1] // 2] ^ y[:, y.shape[1] // 2:]
            for i, own_bits in zip(a, x):
                fit = roots[b] != roots[i]
                fit &= own[b] != own[i] if two else True
                if v == w:
                    fit &= b > i
                total = n[b] + n[i]
                spare = total - 2 * np.ceil(threshold / (1 + threshold) * total - 1e-9).astype(np.int64)
                fit &= np.abs(n[b] - n[i]) <= spare
                at = np.flatnonzero(fit)
                if len(at):
                    differ = np.bitwise_count(y[at] ^ own_bits).sum(axis=1, dtype=np.int64)
                    at = at[differ <= spare[at]]
                    left.append(np.full(len(at), ids[i]))
                    right.append(ids[b[at]])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield values[a:b]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [sketch(labelled_kmers(w)) if len(w) else np.empty(0, np.int64) for w in _lists(batch.column(3))]
        offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
        values = np.concatenate(keys) if keys else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
            names=["doc_id", "h1", "h2", "keys"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kmers = [labelled_kmers(w) for w in _lists(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(k) for k in kmers], pa.int64()),
             pa.array([parity_bits(k).tobytes() for k in kmers], pa.binary())], names=["id", "n", "bits"])


def _compare(threshold: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets, members = lists.offsets.to_numpy(), lists.values
            ids, roots, own, n = (members.field(c).to_numpy(zero_copy_only=False) for c in ("id", "root", "own", "n"))
            bits = members.field("bits")
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                rows = [np.frombuffer(x, np.uint64) for x in bits.slice(a, b - a).to_pylist()]
                left, right = close_pairs(ids[a:b], roots[a:b], own[a:b], n[a:b], rows, threshold)
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])
    return compared


def _verify(threshold: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [similarity(labelled_kmers(x), labelled_kmers(y), threshold)
                 for x, y in zip(_lists(batch.column(2)), _lists(batch.column(3)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["a", "b", "similarity"])
    return verified


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, words): hashes of the word sequence, or of the text if it has no word."""
    hashed = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", word_hashes(F.col("text")).alias("words"))
    same = lambda salt: F.when(F.size("words") > 0, F.xxhash64(F.lit(salt), "words")).otherwise(
        F.xxhash64(F.lit(-salt), "text"))
    return hashed.select("doc_id", same(1).alias("h1"), same(2).alias("h2"), "words")


def _star(buckets: DataFrame) -> DataFrame:
    """(a, b, key): every member of a bucket with its smallest and its largest id, a > b or a < b."""
    ends = buckets.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    return buckets.join(ends, "key").select(
        "key", F.col("id").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b")


def _undecided(buckets: DataFrame, texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): pairs of different roots that share a bucket of ``buckets`` (key, id, root_id) and may be alike."""
    sizes = buckets.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks"))
    ids = buckets.select(F.col("id").alias("doc_id")).distinct()
    bitmaps = texts.join(ids, "doc_id").select("doc_id", "words").mapInArrow(_bitmaps, "id long, n long, bits binary")
    # Every block meets every block, so the parts of a large bucket are dealt out like small ones.
    cut = buckets.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id", "key"), "blocks")).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = cut.join(bitmaps, "id").groupBy(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.struct("id", F.col("root_id").alias("root"), "own", "n", "bits")).alias("members"))
    # Of two blocks only one may have members; these meet each other in their own row.
    some = met.where(F.size("members") > 1).where((F.col("i") == F.col("j")) | (
        F.size(F.array_distinct(F.transform("members", lambda m: m["own"]))) > 1))
    return some.select("members").mapInArrow(_compare(threshold), "a long, b long")


def _texts(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, words) of all representatives that share a bucket; texts are shuffled here only.

    The join is told to shuffle, so it does not depend on how many representatives there are.
    """
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    needed = placed.join(shared, "key").select(F.col("id").alias("doc_id")).distinct()
    hashed = _identified(docs.join(needed.hint("merge"), "doc_id"))
    order = Window.partitionBy("doc_id").orderBy("h1", "h2")
    one = hashed.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return materialize(one.select("doc_id", "words"), "words")


def _links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Verified (a, b, similarity) with a < b, from unordered pairs of representatives."""
    own = materialize(
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    joined = (
        own.join(texts.select(F.col("doc_id").alias("a"), F.col("words").alias("wa")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("words").alias("wb")), "b")
        .select("a", "b", "wa", "wb"))
    checked = joined.mapInArrow(_verify(threshold), "a long, b long, similarity double")
    return materialize(checked.where(F.col("similarity") >= threshold), "links")


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(id, root): the smallest id of the connected component of every id in ``links`` (a, b)."""
    edges = materialize(links.select("a", "b").union(links.select("b", "a")), "edges")
    roots = materialize(edges.groupBy(F.col("a").alias("id")).agg(
        F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    for _ in range(limit):
        seen = edges.join(roots, edges["b"] == roots["id"]).groupBy(F.col("a").alias("id")).agg(
            F.min("root").alias("seen"))
        # A root learns of a smaller root from any member of its tree, then everyone jumps on.
        own = roots.join(seen, "id").select("id", "root", F.least("root", "seen").alias("best"))
        hooks = own.groupBy(F.col("root").alias("id")).agg(F.min("best").alias("hook"))
        moved = own.join(hooks, "id", "left").select(
            "id", "root", F.least("best", F.coalesce("hook", "best")).alias("next"))
        far = roots.select(F.col("id").alias("next"), F.col("root").alias("far"))
        new = materialize(moved.join(far, "next", "left").select(
            "id", F.least("next", F.coalesce("far", "next")).alias("root"), F.col("root").alias("was")), "roots")
        roots = new.select("id", "root")
        if not new.where("root <> was").limit(1).count():
            return roots
    raise RuntimeError(f"components did not settle in {limit} rounds")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id): one row per document id; ``class_id`` is the smallest id of its class.

    Documents are in one class when a chain of pairs with at least ``threshold`` similarity, or of
    equal word sequences, joins them. Texts without words are alike only if equal; null texts are
    alone. Rows without an id are left out. Of rows that repeat an id with different texts one,
    the smallest by hash, counts.
    """
    text_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = _identified(docs).mapInArrow(_sketches, "doc_id long, h1 long, h2 long, keys array<bigint>")
    order = Window.partitionBy("doc_id").orderBy("h1", "h2")
    rows = materialize(found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n"), "sketches")
    first = materialize(rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "copies")
    reps = rows.join(first.select(F.col("rep").alias("doc_id")), "doc_id")
    sketched = materialize(reps.select(F.col("doc_id").alias("id"), "keys"), "representatives")
    placed = sketched.select("id", F.explode("keys").alias("key"))

    texts = _texts(docs, placed)
    links = _links(_star(placed).select("a", "b"), texts, threshold).select("a", "b")
    roots = components(links)

    def rooted(pairs: DataFrame, column: str) -> DataFrame:
        known = roots.select(F.col("id").alias(column), F.col("root").alias("_root"))
        return pairs.join(known, column, "left").withColumn(
            f"root_{column}", F.coalesce("_root", column)).drop("_root")

    def mixed(members: DataFrame) -> DataFrame:
        """(key, id, root_id) of buckets that are not yet of one class, from (id, keys): a member's root is looked up once."""
        classed = rooted(members, "id").select(F.explode("keys").alias("key"), "id", "root_id")
        keys = classed.groupBy("key").agg(
            F.min("root_id").alias("low"), F.max("root_id").alias("high")).where("low < high").select("key")
        return materialize(classed.join(keys, "key"), "mixed")

    # First in the finer keys of two such buckets, then whatever pair of classes is left in one.
    left = mixed(sketched)
    own = left.select("key", "id")
    finer = own.join(own.withColumnRenamed("key", "other"), "id").where("key < other").select(
        "id", F.xxhash64("key", "other").alias("key"))
    fresh = rooted(rooted(_star(finer).select("a", "b").distinct(), "a"), "b").where("root_a <> root_b")
    links = links.union(_links(fresh.select("a", "b"), texts, threshold).select("a", "b"))
    roots = components(links)
    again = mixed(own.groupBy("id").agg(F.collect_list("key").alias("keys")))
    links = links.union(_links(_undecided(again, texts, threshold, block), texts, threshold).select("a", "b"))

    roots = components(links)
    classes = first.join(roots, first["rep"] == roots["id"], "left").select(
        "h1", "h2", F.coalesce("root", "rep").alias("class_id"))
    members = rows.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "class_id")
    unread = docs.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct().join(
        members, "doc_id", "left_anti")
    return members.union(unread.select("doc_id", F.col("doc_id").alias("class_id")))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class; rows without an id stay.

    Rows that repeat an id with other texts are judged each for itself: of the texts of an id one,
    the smallest by hash, keeps the id, the others stand behind all ids. Of rows that repeat id and
    text one stays.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"))
    twice = materialize(rows.where("_id is not null").groupBy("_id").agg(
        F.min("_text").alias("_first"), F.max("_text").alias("_last")).where("_first <> _last").select("_id", "_first"), "repeated")
    if twice.limit(1).count():
        behind = F.xxhash64("_id", "_text").bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 62))
        rows = rows.join(twice, "_id", "left").withColumn(
            "_id", F.when(F.col("_first") != F.col("_text"), behind).otherwise(F.col("_id"))).drop("_first")
    classes = near_duplicates(rows.select(F.col("_id").alias("doc_id"), "row.text"), **settings)
    kept = rows.join(classes.where("doc_id = class_id").select(F.col("doc_id").alias("_id")), "_id")
    order = Window.partitionBy("_id").orderBy("_text")
    kept = kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("row")
    return kept.union(rows.where("_id is null").select("row")).select("row.*")

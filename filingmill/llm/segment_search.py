"""Exact top-k by inner product, with multi-resolution segment statistics.

With the mean m and the deviation s of every segment of length n, the squared distance of two
vectors is at least  sum n * ((mq - mx)^2 + (sq - sx)^2).  As  q.x = (|q|^2 + |x|^2 - d^2) / 2,
that bounds their inner product from above by  sum n * (mq * mx + sq * sx).  Coarse segments
give loose, cheap bounds, finer ones tighter bounds; only pairs whose bound reaches the k-th best
score known so far go to the next level, and survivors are computed exactly in integers.

Queries and candidates are dealt into blocks of bounded size by a hash of their ids. Each pair of
blocks is one group, answered with at most k rows a query; a window with a group limit keeps the
best k of all blocks. Candidates are copied once per block of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

LEVELS = (4, 8, 16)
_RESULT = "query_id long, vec_id long, score long"


def scaled(embedding: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double; null if a component is null or not finite."""
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors in id order; of rows that repeat an id the smallest vector stays."""
    ids = table.column("vec_id").to_numpy()
    lists = table.column("v").combine_chunks()
    flat = (lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)).flatten().to_numpy()
    v = flat.reshape(len(ids), -1)
    order = np.lexsort((*v.T[::-1], ids)) if v.shape[1] else np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return ids[first], v[first]


def _statistics(v: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of ``parts`` segments, weighted so that a dot product sums the bound."""
    out = []
    for cut in np.array_split(v.astype(np.float64), min(parts, max(1, v.shape[1])), axis=1):
        n = math.sqrt(max(1, cut.shape[1]))
        out += [cut.mean(axis=1) * n, cut.std(axis=1) * n] if cut.shape[1] else []
    return np.stack(out, axis=1) if out else np.zeros((len(v), 1))


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Integer inner products of the pairs; beyond 62 bits with Python's integers, held in 64 bits."""
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0))
    out = np.empty(len(qi), np.int64)
    for a in range(0, len(qi), step):
        s = slice(a, a + step)
        if top * max(1, q.shape[1]) < 2.0 ** 62:
            out[s] = np.einsum("ij,ij->i", q[qi[s]], x[xi[s]])
        else:
            big = (q[qi[s]].astype(object) * x[xi[s]].astype(object)).sum(axis=1)
            out[s] = [min(max(int(b), -(1 << 63)), (1 << 63) - 1) for b in big]
    return out


def best_in_block(q_ids, q, x_ids, x, k: int, rows: int = 128) -> Iterator[tuple]:
    """For each query its k best candidates of the block, found coarse to fine."""
    stats = [(_statistics(q, p), _statistics(x, p)) for p in LEVELS]
    slack = 1e-6 + 1e-9 * np.linalg.norm(q.astype(np.float64), axis=1) * \
        np.linalg.norm(x.astype(np.float64), axis=1).max(initial=0)
    for a in range(0, len(q), rows):
        part = np.arange(a, min(a + rows, len(q)))
        bound = stats[0][0][part] @ stats[0][1].T
        own = q_ids[part][:, None] == x_ids[None, :]
        bound[own] = -np.inf
        # The k most promising candidates give each query a first score to beat.
        m = min(k + 1, len(x))
        first = np.argpartition(-bound, m - 1, axis=1)[:, :m]
        qi, xi = np.repeat(part, m), first.ravel()
        score = np.where(q_ids[qi] == x_ids[xi], np.iinfo(np.int64).min, _exact(q, x, qi, xi))
        score = np.sort(score.reshape(len(part), m), axis=1)[:, ::-1]
        limit = score[:, k - 1].astype(np.float64) if m >= k else np.full(len(part), -np.inf)
        limit[limit <= np.iinfo(np.int64).min] = -np.inf
        limit -= slack[part]
        qi, xi = np.nonzero((bound >= limit[:, None]) & ~own)
        for sq, sx in stats[1:]:
            keep = np.empty(len(qi), bool)
            for b in range(0, len(qi), 1 << 16):
                s = slice(b, b + (1 << 16))
                keep[s] = np.einsum("ij,ij->i", sq[part[qi[s]]], sx[xi[s]]) >= limit[qi[s]]
            qi, xi = qi[keep], xi[keep]
        score = _exact(q, x, part[qi], xi)
        order = np.lexsort((x_ids[xi], -score.astype(object) if (score == np.iinfo(np.int64).min).any() else -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left")
        top = rank < k
        yield q_ids[part[qi[top]]], x_ids[xi[top]], score[top]


def top_inner_products(
    vectors: DataFrame, is_query: Column, k: int = 5, query_block: int = 1024, block: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every query, ties to smaller ids.

    ``vectors`` has ``vec_id`` and ``v`` (array of long); rows where either is null take no part.
    ``is_query`` chooses the queries; a query never meets its own id. Vectors meet only vectors
    of their length. Rows that repeat an id count once, as the smallest of their vectors.
    An empty table gives no rows.
    """
    known = vectors.where("vec_id is not null and v is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), "v", F.size("v").alias("dim"), is_query.alias("asks"))
    n, asked = known.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, math.ceil(n / block)), max(1, math.ceil(asked / query_block))

    def dealt(own: str, count: int, other: str, others: int) -> list[Column]:
        return [F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias(own),
                F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)]

    queries = known.where("asks").select("vec_id", "v", "dim", *dealt("qb", query_blocks, "cb", blocks))
    rows = known.select("vec_id", "v", "dim", *dealt("cb", blocks, "qb", query_blocks))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[], [], []]
        if left.num_rows and right.num_rows:
            for part in best_in_block(*_vectors(left), *_vectors(right), k):
                for to, values in zip(found, part):
                    to.append(values)
        return pa.table({
            name: pa.array(np.concatenate(x) if x else [], pa.int64())
            for name, x in zip(("query_id", "vec_id", "score"), found)})

    key = ("dim", "qb", "cb")
    per_block = queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(answer, _RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        per_block.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score"))

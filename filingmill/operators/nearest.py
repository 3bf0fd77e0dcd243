"""Nearest vectors by cosine, exact or in trained cells, block by block.

Both sides are cut into blocks of bounded size inside each group: one group per vector length
for the exact search, blocks of near cells for the approximate one. Every pair of blocks of a group is one
task: a matrix product that hands on only the ``k`` best per query. Pairs never become rows,
no side passes through the driver, and a group with a third of all vectors is simply cut into
more blocks. A last ranking keeps ``k`` of the per-block results.

Cells are spherical k-means clusters, trained on a bounded sample of the names. A name lies in the
cell of its nearest centroid; a query looks into as many near cells as its sampled fellows need to
find the wanted share of their true neighbours, and on until these hold ``k`` names. Cells near each
other share a block of names, so a query is copied once per block that holds a cell it probes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F, types as T

QUERY_BLOCK = 4096
NAME_BLOCK = 8192
MIN_NAME_BLOCK = 512

# Bounds of what reaches the driver and every task: values of sampled vectors, and of centroids.
SAMPLE_VALUES, CENTROID_VALUES = 1 << 21, 1 << 18
# Rows that get their cells at a time.
ADDED_ROWS = 1024


@dataclass(frozen=True)
class Cells:
    """Cells of vectors of length ``dim``, probed until ``recall`` of the true neighbours is found.

    ``sample`` names train the centroids; for ``asked`` queries the true neighbours among them are
    found, and the number of cells to probe is the smallest that holds ``recall`` of these. Sampled
    names lie thinner than all names, so that measures harder cases than the search meets. Without
    ``cells`` their number is about the square root of the number of names.
    """

    dim: int
    recall: float = 0.95
    sample: int = 32_768
    asked: int = 512
    cells: int | None = None


def top_neighbours(
    queries: DataFrame,
    names: DataFrame,
    k: int = 10,
    cells: Cells | None = None,
    query_block: int = QUERY_BLOCK,
    name_block: int = NAME_BLOCK,
) -> DataFrame:
    """The ``k`` most similar names per query, most similar first, ties by name.

    ``queries``: query_id, query_embedding. ``names``: employer_name, total_h1b_certified,
    embedding. Rows without a usable vector take no part. With ``cells`` only names of the cells
    nearest to a query are compared; vectors of another length than theirs are answered exactly.
    Returns query_id, employer_name, total_h1b_certified, similarity, place.
    """
    q = queries.where(F.col("query_embedding").isNotNull()).select(
        "query_id", F.col("query_embedding").alias("vector"))
    e = names.where(F.col("embedding").isNotNull()).select(
        "employer_name",
        F.coalesce("total_h1b_certified", F.lit(0)).cast("long").alias("total_h1b_certified"),
        F.col("embedding").alias("vector"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "employer_name")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    def exact(asked: DataFrame) -> DataFrame:
        # Only vectors of one length can be compared.
        sides = (d.withColumn("bucket", F.size("vector")) for d in (asked, e))
        return best(_per_block(*_blocks(*sides, query_block, name_block), k))

    if cells is None:
        return exact(q)
    near = best(_in_cells(q, e, k, cells, query_block, name_block))
    others = q.where(F.size("vector") != cells.dim)
    return near.unionByName(exact(others)) if others.limit(1).count() else near


def _blocks(q: DataFrame, e: DataFrame, query_block: int, name_block: int):
    """Give each side its own block number and repeat it for every block of the other.

    The block counts have one row per bucket: one per vector length, or at most tables x 2^bits,
    so sending them to every task is safe however many vectors there are.
    """
    cores = q.sparkSession.sparkContext.defaultParallelism
    n_e, n_q = F.col("n_e"), F.col("n_q")
    fair = F.greatest(F.ceil(n_e / cores), F.lit(MIN_NAME_BLOCK))
    sizes = (
        q.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_q"))
        .join(e.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_e")), "bucket")
        .select("bucket", F.ceil(n_q / query_block).alias("q_blocks"),
                F.ceil(n_e / F.least(fair, F.lit(name_block))).alias("e_blocks"))
    )
    sizes = F.broadcast(sizes)

    def cut(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return (
            side.join(sizes, "bucket")
            .withColumn(own[0] + "_block", F.pmod(F.xxhash64(key), F.col(own)))
            .withColumn(other[0] + "_block", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop(own, other)
        )

    return cut(q, "query_id", "q_blocks", "e_blocks"), cut(e, "employer_name", "e_blocks", "q_blocks")


def _found(q: DataFrame) -> T.StructType:
    return T.StructType([
        q.schema["query_id"],
        T.StructField("employer_name", T.StringType()),
        T.StructField("total_h1b_certified", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
    ])


def _per_block(q: DataFrame, e: DataFrame, k: int) -> DataFrame:
    keys = ["bucket", "q_block", "e_block"]

    def best(left, right):
        return _best_in_block(left, right, k)

    return q.groupBy(*keys).cogroup(e.groupBy(*keys)).applyInArrow(best, _found(q))


@dataclass(frozen=True)
class Trained:
    """Unit centroids and the number of them that a query probes."""

    centroids: object
    probes: int
    never = 1 << 30

    def ranks(self, units, sizes, k: int):
        """Each cell's rank for each vector, nearest 0; ``never`` for cells that are not probed.

        The nearest ``probes`` cells are, and on until they hold ``k`` names.
        """
        import numpy as np

        near = _nearest_cells(units, self.centroids, len(self.centroids))
        wanted = np.maximum(self.probes, (np.cumsum(sizes[near], axis=1) < k).sum(axis=1) + 1)
        places = np.broadcast_to(np.arange(near.shape[1]), near.shape)
        out = np.empty(near.shape, np.int64)
        np.put_along_axis(out, near, np.where(places < wanted[:, None], places, self.never), axis=1)
        return out


class _Block:
    """Vectors of queries and names of one pair of blocks, and the k best of candidate pairs.

    Candidates within rounding distance of the k-th best are scored again term by term, so the
    result does not depend on how the blocks were cut.
    """

    def __init__(self, q, e, k: int) -> None:
        import numpy as np

        def matrix(column):
            whole = column.combine_chunks()
            flat = np.asarray(whole.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            return flat.reshape(len(whole), -1)

        def length(m):
            total = np.zeros(len(m))
            for j in range(m.shape[1]):
                total += m[:, j] * m[:, j]
            return np.sqrt(total)

        self.q, self.e, self.k, self.parts = q, e, k, []
        self.empty = q.num_rows == 0 or e.num_rows == 0
        if self.empty:
            return
        qv, ev = matrix(q["vector"]), matrix(e["vector"])
        qn, en = length(qv), length(ev)
        self.q_ok, self.e_ok = np.flatnonzero(qn > 0), np.flatnonzero(en > 0)
        self.empty = len(self.q_ok) == 0 or len(self.e_ok) == 0
        if self.empty:
            return
        self.qv, self.qn, self.ev, self.en = qv[self.q_ok], qn[self.q_ok], ev[self.e_ok], en[self.e_ok]
        names = np.array(e["employer_name"].to_pylist(), dtype=object)[self.e_ok]
        self.name_place = np.empty(len(names), dtype=np.int64)
        self.name_place[np.argsort(names, kind="stable")] = np.arange(len(names))
        self.unit_q, self.unit_e = self.qv / self.qn[:, None], self.ev / self.en[:, None]

    def keep(self, qi, ei) -> None:
        """Score pairs of places of queries and names, all those of a query, and keep its k best."""
        import numpy as np

        exact = np.zeros(len(qi))
        for j in range(self.ev.shape[1]):
            exact += self.qv[qi, j] * self.ev[ei, j]
        exact /= self.qn[qi] * self.en[ei]
        order = np.lexsort((self.name_place[ei], -exact, qi))
        qi, ei, exact = qi[order], ei[order], exact[order]
        first = np.searchsorted(qi, qi, side="left")
        kept = np.arange(len(qi)) - first < self.k
        self.parts.append((self.q_ok[qi[kept]], self.e_ok[ei[kept]], exact[kept]))

    def table(self):
        import numpy as np
        import pyarrow as pa

        rows = [np.concatenate(c) for c in zip(*self.parts)] or [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        at_q, at_e = (pa.array(c, pa.int64()) for c in rows[:2])
        return pa.table({
            "query_id": self.q["query_id"].take(at_q), "employer_name": self.e["employer_name"].take(at_e),
            "total_h1b_certified": self.e["total_h1b_certified"].take(at_e), "similarity": pa.array(rows[2], pa.float64())})


def _best_in_block(q, e, k: int):
    """The k best names per query of one pair of blocks, as an Arrow table."""
    import numpy as np

    block = _Block(q, e, k)
    if block.empty:
        return block.table()
    step = max(1, (1 << 22) // len(block.unit_e))
    for lo in range(0, len(block.unit_q), step):
        rough = block.unit_q[lo:lo + step] @ block.unit_e.T
        if rough.shape[1] > k:
            bar = np.partition(rough, -k, axis=1)[:, -k][:, None] - 1e-9
            qi, ei = np.nonzero(rough >= bar)
        else:
            qi, ei = (x.ravel() for x in np.indices(rough.shape))
        block.keep(lo + qi, ei)
    return block.table()


def _best_in_cells(q, e, k: int, trained: Trained, sizes):
    """Like ``_best_in_block``, but each query meets only names of the cells it probes.

    A query's nearest cell here gives the score that names of its other cells have to reach.
    """
    import numpy as np

    block = _Block(q, e, k)
    if block.empty:
        return block.table()
    cell = e["cell"].to_numpy()[block.e_ok]
    by_cell = np.argsort(cell, kind="stable")
    here, starts = np.unique(cell[by_cell], return_index=True)
    members = np.split(by_cell, starts[1:])
    for lo in range(0, len(block.unit_q), QUERY_BLOCK):
        unit = block.unit_q[lo:lo + QUERY_BLOCK]
        rank = trained.ranks(unit, sizes, k)[:, here]
        nearest = rank.argmin(axis=1)
        bar = np.full(len(unit), -np.inf)
        found = []
        for first in (True, False):
            for c, names in enumerate(members):
                asks = np.flatnonzero((rank[:, c] < trained.never) & ((nearest == c) == first))
                if not len(asks):
                    continue
                rough = unit[asks] @ block.unit_e[names].T
                if first and rough.shape[1] >= k:
                    bar[asks] = np.partition(rough, -k, axis=1)[:, -k] - 1e-9
                i, j = np.nonzero(rough >= bar[asks][:, None])
                found.append((asks[i], names[j]))
        if found:
            block.keep(*(np.concatenate(x) + (lo if n == 0 else 0) for n, x in enumerate(zip(*found))))
    return block.table()


def train(names, queries, k: int, count: int, recall: float, rounds: int = 10) -> Trained:
    """Spherical k-means over sampled unit names, and the probes that sampled queries need."""
    import numpy as np

    count = max(1, min(count, len(names)))
    centroids = names[np.linspace(0, len(names) - 1, count).astype(int)].copy() if len(names) else np.zeros((1, names.shape[1]))
    cell = np.zeros(len(names), int)
    for _ in range(rounds if len(names) else 0):
        cell = _nearest_cells(names, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, names)
        size = np.sqrt((sums ** 2).sum(axis=1))
        # An empty cell keeps its centroid.
        centroids = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centroids)
    cell = _nearest_cells(names, centroids, 1)[:, 0] if len(names) else cell
    if not len(queries) or not len(names):
        return Trained(centroids, len(centroids))
    places = np.argsort(_nearest_cells(queries, centroids, len(centroids)), axis=1)
    found = []
    for a in range(0, len(queries), 64):
        rough = queries[a:a + 64] @ names.T
        true = np.argpartition(-rough, min(k, len(names)) - 1, axis=1)[:, :k]
        found.append(np.take_along_axis(places[a:a + 64], cell[true], axis=1).ravel())
    ranks = np.sort(np.concatenate(found))
    return Trained(centroids, int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1)


def _nearest_cells(vectors, centroids, n: int):
    """Places of the ``n`` nearest centroids, nearest first, ties to the smaller place."""
    import numpy as np

    rough = vectors @ centroids.T
    return rough.argmax(axis=1)[:, None] if n == 1 else np.argsort(-rough, axis=1, kind="stable")[:, :n]


def _units(column, dim: int):
    """Vectors as rows of length 1; rows without a direction stay zero."""
    import numpy as np

    whole = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = np.asarray(whole.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    size = np.sqrt((flat * flat).sum(axis=1))
    return flat / np.where(size > 0, size, 1)[:, None], size > 0


def _gathered(side: DataFrame, key: str, bound: int):
    """(rows, at most ``bound`` vectors of them in the order of their keys): all, or the same sample always."""
    few = side.select(key, "vector")
    table = few.limit(bound + 1).toArrow()
    rows = table.num_rows
    if rows > bound:
        rows = side.count()
        place = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 40))
        share = 4 * bound / rows
        few = few.where(place < int(share * (1 << 40))) if share < 1 else few
        table = few.orderBy(place, key).limit(bound).toArrow()
    return rows, table.sort_by(key).column("vector")


def _chained(centroids):
    """The cells in a chain in which each is followed by the nearest one that is left."""
    import numpy as np

    left, at, out = np.ones(len(centroids), bool), 0, []
    for _ in range(len(centroids)):
        left[at] = False
        out.append(at)
        at = int(np.where(left, centroids @ centroids[at], -np.inf).argmax())
    return out


def _in_cells(q: DataFrame, e: DataFrame, k: int, how: Cells, query_block: int, name_block: int) -> DataFrame:
    """The k best names per query and pair of blocks, of the cells that the query probes.

    The driver holds the bounded sample and a few numbers per cell and block.
    """
    import numpy as np

    dim = how.dim
    q, e = (side.where(F.size("vector") == dim) for side in (q, e))
    bound = max(1, min(how.sample, SAMPLE_VALUES // max(1, dim)))
    n, names = _gathered(e, "employer_name", bound)
    asked, queries = _gathered(q, "query_id", min(query_block, bound))
    names, queries = (units[usable] for units, usable in (_units(x, dim) for x in (names, queries)))
    count = min(how.cells or math.isqrt(n) + 1, CENTROID_VALUES // max(1, dim), max(1, n))
    trained = train(names, queries[:: max(1, len(queries) // how.asked)], k, count, how.recall)
    cells = len(trained.centroids)

    def in_cell(batch, column: str = "vector"):
        """Unit vectors, the places of those with a direction, and their nearest cells."""
        units, usable = _units(batch.column(batch.schema.get_field_index(column)), dim)
        at = np.flatnonzero(usable)
        return units[at], at, _nearest_cells(units[at], trained.centroids, 1)[:, 0]

    def added(side: DataFrame, columns: list[str], place) -> DataFrame:
        """Rows as ``place`` copies them, with whole numbers added; ``_h`` is a hash of the key."""
        key, own = side.columns[0], [f.name for f in side.schema.fields]
        schema = T.StructType(side.schema.fields + [T.StructField(c, T.IntegerType()) for c in columns])

        def run(batches: Iterator):
            import pyarrow as pa

            for batch in batches:
                for a in range(0, batch.num_rows, ADDED_ROWS):
                    part = batch.slice(a, ADDED_ROWS)
                    row, *values = place(part, part.column(part.num_columns - 1).to_numpy())
                    taken = part.drop_columns(["_h"]).take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, *[pa.array(v, pa.int32()) for v in values]], names=[*own, *columns])

        return side.withColumn("_h", F.pmod(F.xxhash64(key), F.lit(1 << 30))).mapInArrow(run, schema)

    def counts(numbers: DataFrame, size: int) -> np.ndarray:
        out = np.zeros(size, int)
        for number, rows in numbers.groupBy(numbers.columns[-1]).count().collect():
            out[number] = rows
        return out

    def cell_only(batch, _):
        _, at, cell = in_cell(batch)
        return at, cell

    if n <= bound:
        sizes = np.bincount(_nearest_cells(names, trained.centroids, 1)[:, 0], minlength=cells) if len(names) else np.zeros(cells, int)
    else:
        sizes = counts(added(e, ["cell"], cell_only), cells)
    # Cells in their chain fill blocks; one larger than a block has several of its own.
    cores = q.sparkSession.sparkContext.defaultParallelism
    full = int(np.clip(-(-n // cores), MIN_NAME_BLOCK, name_block))
    first, parts = np.zeros(cells, int), np.maximum(1, -(-sizes // full))
    blocks, held = 0, 0
    for c in _chained(trained.centroids):
        if held and held + sizes[c] > full:
            blocks, held = blocks + 1, 0
        first[c], held = blocks, held + sizes[c]
        if parts[c] > 1:
            blocks, held = blocks + int(parts[c]), 0
    blocks += 1
    owner = [np.flatnonzero((first <= b) & (b < first + parts) & (sizes > 0)) for b in range(blocks)]

    def name_rows(batch, hashes):
        _, at, cell = in_cell(batch)
        return at, cell, first[cell] + hashes[at] % parts[cell]

    # Queries with their nearest cells in one block form blocks, too.
    q_parts = np.ones(blocks, int)
    if asked > query_block:
        q_parts = np.maximum(1, -(-counts(added(q, ["home"], lambda batch, _: (
            lambda at, cell: (at, first[cell]))(*in_cell(batch)[1:])), blocks) // query_block))
    q_first = np.cumsum(q_parts) - q_parts if asked > query_block else np.zeros(blocks, int)

    def query_rows(batch, hashes):
        units, at, cell = in_cell(batch)
        probed = trained.ranks(units, sizes, k) < trained.never
        i, block = np.nonzero(np.stack([probed[:, own].any(axis=1) for own in owner], axis=1))
        home = first[cell][i]
        return at[i], block, q_first[home] + hashes[at[i]] % q_parts[home]

    left = added(q, ["e_block", "q_block"], query_rows)
    right = added(e, ["cell", "e_block"], name_rows)
    if asked > query_block:
        # Under names of their own, as both sides meet again below.
        pairs = left.select(F.col("e_block").alias("_e"), F.col("q_block").alias("_q")).distinct()
        right = right.join(pairs, right["e_block"] == pairs["_e"]).withColumn("q_block", F.col("_q") + 0).drop("_e", "_q")
    else:
        right = right.withColumn("q_block", F.lit(0))
    keys = ["e_block", "q_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda a, b: _best_in_cells(a, b, k, trained, sizes), _found(q))

"""Hard-negative mining with score bounds along a spanning tree of anchors.

For anchors a and p and a candidate x,  |a.x - p.x| <= |a - p| * |x|.  The anchors of a block form
a minimum spanning tree; the root's scores are computed, and every child's scores lie within its
parent's, exact or themselves bounds, plus or minus the edge's length times the candidate's norm.
Only candidates whose interval meets a window are scored again, in integers.

Twice this is done. First, in blocks of one label, for the positives: there the window of an anchor
begins at the k-th best score it has so far. Then for the negatives: an anchor has one window of
scores for each of its positives. Here a pivot stands for each cell of near anchors, as the root
above their trees: a candidate is scored against the pivots before anything is shuffled and goes
only to cells with a window that it can reach. Pivots are bounded in number and bytes; cells of
many anchors are cut into blocks, and so are candidates, so no group grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.materialize import materialize

# Anchors and candidates of a block, candidates bounded at a time, and bounds of what is broadcast.
ANCHORS, CANDIDATES, ROWS = 512, 8192, 1024
PIVOTS, PIVOT_VALUES = 1024, 1 << 20
_EXACT = 2.0 ** 53


def _matrix(column) -> np.ndarray:
    """Vectors of one length as the rows of a matrix of longs."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def scores(anchor: np.ndarray, x: np.ndarray, floats: np.ndarray | None) -> np.ndarray:
    """Integer inner products; as doubles while these are exact, else in Python's integers, held in 64 bits."""
    if floats is not None:
        return (floats @ anchor.astype(np.float64)).astype(np.int64)
    whole = (x.astype(object) * anchor.astype(object)).sum(axis=1) if x.shape[1] else np.zeros(len(x))
    return np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in whole], np.int64)


def spanning_tree(q: np.ndarray) -> list[tuple[int, int, float]]:
    """(anchor, parent, length) in an order in which parents come first; the root is its own parent.

    A minimum spanning tree by Prim's method on the distances of one row at a time.
    """
    points = q.astype(np.float64)
    near, parent = np.full(len(q), np.inf), np.zeros(len(q), int)
    left = np.ones(len(q), bool)
    out, at = [], 0
    for n in range(len(q)):
        left[at] = False
        out.append((at, int(parent[at]), float(near[at]) if n else 0.0))
        gap = np.sqrt(((points - points[at]) ** 2).sum(axis=1))
        closer = left & (gap < near)
        near[closer], parent[closer] = gap[closer], at
        at = int(np.where(left, near, np.inf).argmin()) if left.any() else at
    return out


class Bounds:
    """Intervals of the scores of all anchors with a part of the candidates, along the tree."""

    def __init__(self, q: np.ndarray, x: np.ndarray) -> None:
        self.q, self.x, self.tree = q, x, spanning_tree(q)
        top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0))
        self.floats = x.astype(np.float64) if top * max(1, x.shape[1]) < _EXACT else None
        self.norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        # Distances and norms are rounded; this is far more than their error.
        self.slack = 1e-6 + 1e-9 * float(np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) * self.norm

    def exact(self, anchor: int, rows: np.ndarray) -> np.ndarray:
        return scores(self.q[anchor], self.x[rows], None if self.floats is None else self.floats[rows])

    def visit(self, rescored) -> None:
        """Call ``rescored(anchor, rows, low, high)`` for every anchor and part of the candidates.

        It returns places within ``rows`` and their exact scores, which narrow the children's bounds.
        """
        for a in range(0, len(self.x), ROWS):
            rows = np.arange(a, min(a + ROWS, len(self.x)))
            known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for anchor, parent, length in self.tree:
                if parent in known and parent != anchor:
                    reach = length * self.norm[rows] * (1 + 1e-9) + self.slack[rows]
                    low, high = known[parent][0] - reach, known[parent][1] + reach
                else:
                    low = high = self.exact(anchor, rows).astype(np.float64)
                    # Beyond 53 bits the double of a score is off by less than this.
                    low, high = low - np.abs(low) * 2.0 ** -52, high + np.abs(high) * 2.0 ** -52
                at, score = rescored(anchor, rows, low, high)
                low, high = low.copy(), high.copy()
                value = score.astype(np.float64)
                low[at], high[at] = value - np.abs(value) * 2.0 ** -52, value + np.abs(value) * 2.0 ** -52
                known[anchor] = (low, high)


def _table(found: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*found)] if found else [[] for _ in names]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def _ordered(score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Highest scores first, ties by smaller id; without negating, which the smallest long has not."""
    return np.lexsort((ids, ~score))


def best_positives(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> list[tuple]:
    """(anchors, ids, scores) with each anchor's first ``k`` others of the block."""
    bounds = Bounds(q, x)
    best = {i: (np.empty(0, np.int64), np.empty(0, np.int64)) for i in range(len(q))}

    def rescored(anchor, rows, low, high):
        ids, score = best[anchor]
        others = x_ids[rows] != q_ids[anchor]
        if len(ids) < k:
            # The most promising rows give a first k-th score to beat.
            some = np.flatnonzero(others)
            some = some[np.argsort(-low[some], kind="stable")[:k]]
            first = bounds.exact(anchor, rows[some])
            limit = np.sort(np.r_[score, first])[::-1][k - 1] if len(score) + len(first) >= k else None
        else:
            limit = score[-1]
        at = np.flatnonzero(others if limit is None else others & (high >= limit - abs(float(limit)) * 2.0 ** -52))
        exact = bounds.exact(anchor, rows[at])
        all_ids, all_scores = np.r_[ids, x_ids[rows[at]]], np.r_[score, exact]
        order = _ordered(all_scores, all_ids)[:k]
        best[anchor] = all_ids[order], all_scores[order]
        return at, exact

    bounds.visit(rescored)
    return [(np.full(len(ids), q_ids[i]), ids, score) for i, (ids, score) in best.items()]


def best_negatives(q_ids, q_labels, q, positives, x_ids, x_labels, x, k: int) -> list[tuple]:
    """(anchors, positives, ids, positive scores, scores): the first ``k`` of each window in the block.

    ``positives`` has for every anchor its (positive_id, positive_score, low, high), the window's
    whole scores.
    """
    bounds = Bounds(q, x)
    none = np.empty(0, np.int64)
    best = {(i, p[0]): (none, none) for i in range(len(q)) for p in positives[i]}

    def rescored(anchor, rows, low, high):
        other = x_labels[rows] != q_labels[anchor]
        meets = np.zeros(len(rows), bool)
        for _, _, least, most in positives[anchor]:
            meets |= (high >= float(least) - abs(least) * 2.0 ** -52) & (low <= float(most) + abs(most) * 2.0 ** -52)
        at = np.flatnonzero(other & meets)
        exact = bounds.exact(anchor, rows[at])
        ids = x_ids[rows[at]]
        for p, _, least, most in positives[anchor]:
            inside = (exact >= least) & (exact <= most)
            held = best[anchor, p]
            all_ids, all_scores = np.r_[held[0], ids[inside]], np.r_[held[1], exact[inside]]
            order = _ordered(all_scores, all_ids)[:k]
            best[anchor, p] = all_ids[order], all_scores[order]
        return at, exact

    bounds.visit(rescored)
    out = []
    for i in range(len(q)):
        for p, score, _, _ in positives[i]:
            ids, found = best[i, p]
            n = len(ids)
            out.append((np.full(n, q_ids[i]), np.full(n, p), ids, np.full(n, score), found))
    return out


def _dealt(blocks: int, name: str, of: str = "vec_id") -> Column:
    return F.pmod(F.xxhash64(F.lit(name), of), F.lit(blocks)).cast("int").alias(name)


def _copied(blocks: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)


def _apart(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for two sides that come from one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _first(found: DataFrame, by: list[str], k: int, score: str, tie: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives_of(vectors: DataFrame, is_anchor: Column, k: int, anchors: int, candidates: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): each anchor's first ``k`` others of its label."""
    labels = vectors.groupBy("dim", "label").agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("asked"))
    most, asked = labels.agg(F.max("n"), F.max("asked")).first()
    qs, cs = max(1, -(-(asked or 0) // anchors)), max(1, -(-(most or 0) // candidates))
    key = ["dim", "label", "qb", "cb"]
    queries = vectors.where(is_anchor).select("dim", "label", "vec_id", "v", _dealt(qs, "qb"), _copied(cs, "cb"))
    # A label without anchors has no positives to find.
    asking = labels.where("asked > 0").select("dim", "label")
    rows = vectors.join(F.broadcast(asking), ["dim", "label"]) if asking.count() <= 10_000 else vectors.join(
        asking, ["dim", "label"])
    rows = _apart(rows.select("dim", "label", "vec_id", "v", _dealt(cs, "cb"), _copied(qs, "qb")))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = best_positives(
                left.column("vec_id").to_numpy(), _matrix(left.column("v")),
                right.column("vec_id").to_numpy(), _matrix(right.column("v")), k)
        return _table(found, ["anchor_id", "positive_id", "positive_score"])

    per_block = queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(
        answer, "anchor_id long, positive_id long, positive_score long")
    return _first(per_block, ["anchor_id"], k, "positive_score", "positive_id").drop("rank")


class Pivots:
    """A bounded number of anchors by length of vector, as plain arrays that travel to tasks."""

    def __init__(self, rows: list) -> None:
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for number, row in enumerate(rows):
            numbers, points = self.by_dim.setdefault(row["dim"], ([], []))
            numbers.append(number)
            points.append(row["v"])
        self.by_dim = {
            d: (np.array(n), np.array(p, np.float64).reshape(len(n), d)) for d, (n, p) in self.by_dim.items()}

    def batches(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(rows of the batch, vectors, numbers of the pivots, pivots) for each length of vector."""
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x = _matrix(batch.column("v").take(pa.array(at))).astype(np.float64)
            yield at, x, *self.by_dim.get(int(d), (np.empty(0, int), np.empty((0, int(d)))))


def _celled(anchors: DataFrame, pivots: Pivots) -> DataFrame:
    """``anchors`` with the nearest pivot of their length, ``cell``, and the distance, ``radius``."""
    schema = ", ".join(f"{n} {t}" for n, t in anchors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, radius = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for at, x, numbers, points in pivots.batches(batch):
                for a in range(0, len(at) if len(numbers) else 0, ROWS):
                    part = x[a:a + ROWS]
                    gap = (part ** 2).sum(1)[:, None] - 2 * part @ points.T + (points ** 2).sum(1)
                    near = gap.argmin(axis=1)
                    cells[at[a:a + ROWS]] = numbers[near]
                    # Exactly, not from the expanded square.
                    radius[at[a:a + ROWS]] = np.sqrt(((part - points[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, pa.int32()), pa.array(radius)], names=[*batch.schema.names, "cell", "radius"])

    return anchors.mapInArrow(run, f"{schema}, cell int, radius double")


def _reaching(rows: DataFrame, pivots: Pivots, cells: dict[int, tuple[float, float, float]]) -> DataFrame:
    """``rows`` once for every ``cell`` with a window that they can reach; -1 has lengths without a pivot."""
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x, numbers, points in pivots.batches(batch):
                used = [i for i, n in enumerate(numbers) if int(n) in cells]
                if not len(numbers) and -1 in cells:
                    taken, cell = at, np.full(len(at), -1)
                    yield _with_cell(batch, taken, cell)
                for a in range(0, len(at) if used else 0, ROWS):
                    part, own = x[a:a + ROWS], points[used]
                    low, high, radius = np.array([cells[int(numbers[i])] for i in used]).T
                    score, norm = part @ own.T, np.sqrt((part ** 2).sum(axis=1))[:, None]
                    size = np.sqrt((own ** 2).sum(axis=1)) + radius
                    slack = 1e-6 + 1e-9 * size * norm
                    reach = radius * norm * (1 + 1e-9) + slack
                    i, j = np.nonzero((score + reach >= low - np.abs(low) * 1e-12) & (score - reach <= high + np.abs(high) * 1e-12))
                    yield _with_cell(batch, at[a + i], numbers[np.array(used)[j]])

    return rows.mapInArrow(run, f"{schema}, cell int")


def _with_cell(batch: pa.RecordBatch, at: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    taken = batch.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [*taken.columns, pa.array(cells, pa.int32())], names=[*batch.schema.names, "cell"])


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95,
    anchors: int = ANCHORS, candidates: int = CANDIDATES, pivots: int = PIVOTS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, label and v (array of long); rows where any is null take no part, and
    vectors meet only vectors of their length. ``is_anchor`` chooses the anchors by vec_id and
    label. An anchor's positives are its first ``positives`` others of its label; for each of them,
    the first ``negatives`` rows of other labels whose score is ``least`` to ``most`` hundredths of
    the positive's score are returned, highest first, ties by smaller id. A negative positive score
    has no such rows. Of rows that repeat an id the one with the smallest label, then vector,
    counts. An empty table gives no rows.
    """
    known = vectors.where("vec_id is not null and label is not null and v is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.struct(
            F.col("label").cast("long").alias("label"), F.col("v")).alias("row"))
    known = materialize(known.groupBy("vec_id").agg(F.min("row").alias("row")).select(
        "vec_id", "row.label", "row.v", F.size("row.v").alias("dim")), "vectors")
    pairs = materialize(positives_of(known, is_anchor, positives, anchors, candidates), "positives")

    # The whole scores s with least * p <= 100 * s <= most * p.
    p = F.col("positive_score").cast("decimal(38,0)")
    wanted = pairs.select("anchor_id", "positive_id", "positive_score", F.ceil(p * least / 100).cast("long").alias("low"),
                          F.floor(p * most / 100).cast("long").alias("high")).where("low <= high")
    windows = wanted.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct(
        "positive_id", "positive_score", "low", "high"))).alias("windows"))
    asking = materialize(known.join(windows, "vec_id"), "anchors")

    # Pivots: anchors spread by a hash, as many as the anchors' blocks but bounded.
    widest, asked = asking.agg(F.coalesce(F.max("dim"), F.lit(0)), F.count("*")).first()
    count = max(1, min(pivots, PIVOT_VALUES // max(1, widest), -(-asked // anchors)))
    points = Pivots(asking.select("dim", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect())
    celled = materialize(_celled(asking, points), "celled")
    ranges = celled.select("cell", "radius", F.explode("windows").alias("w")).groupBy("cell").agg(
        F.min("w.low").alias("low"), F.max("w.high").alias("high"), F.max("radius").alias("radius"))
    sizes = celled.groupBy("cell").agg(F.count("*").alias("n"))
    cells = {r["cell"]: (float(r["low"]), float(r["high"]), r["radius"], r["n"]) for r in ranges.join(
        sizes, "cell").collect()}  # one row per pivot, and one for lengths without
    rows = known.count()
    cs = max(1, -(-rows // candidates))
    blocks = {c: max(1, math.ceil(x[3] / anchors)) for c, x in cells.items()}
    by_cell = F.coalesce(F.element_at(F.create_map(
        *[F.lit(x) for c, b in blocks.items() for x in (c, b)]), F.col("cell")), F.lit(1)) if blocks else F.lit(1)
    key = ["dim", "cell", "qb", "cb"]
    queries = celled.select(
        "dim", "cell", "vec_id", "label", "v", "windows",
        F.pmod(F.xxhash64(F.lit("qb"), "vec_id"), by_cell).cast("int").alias("qb"), _copied(cs, "cb"))
    reached = _reaching(known.select("dim", "vec_id", "label", "v"), points, {c: x[:3] for c, x in cells.items()})
    reached = _apart(reached.select(
        "dim", "cell", "vec_id", "label", "v", _dealt(cs, "cb"),
        F.explode(F.sequence(F.lit(0), by_cell.cast("int") - 1)).alias("qb")))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            own = [[(w["positive_id"], w["positive_score"], w["low"], w["high"]) for w in ws]
                   for ws in left.column("windows").to_pylist()]
            found = best_negatives(
                left.column("vec_id").to_numpy(), left.column("label").to_numpy(), _matrix(left.column("v")), own,
                right.column("vec_id").to_numpy(), right.column("label").to_numpy(), _matrix(right.column("v")), negatives)
        return _table(found, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    per_block = queries.groupBy(*key).cogroup(reached.groupBy(*key)).applyInArrow(
        answer, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    return _first(per_block, ["anchor_id", "positive_id"], negatives, "negative_score", "negative_id").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

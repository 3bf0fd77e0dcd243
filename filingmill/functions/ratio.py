"""Partial ratio of two texts, 0 to 100.

The blocks that the shorter text shares with the longer one, longest first and then to both sides
of it, say which windows of the longer text are worth a look; a window's ratio is twice the
characters of the blocks it shares with the shorter text over the characters of both. Windows are
cut and compared by Spark; blocks are found for all rows of a batch at once: one step of the
table of common runs is one operation on an array with a row for every open stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType

# Below this length every character of the longer text counts; from it on frequent ones start no
# block, so even a contained text may score less than 100.
WHOLE_BELOW = 200
# Cells of the arrays worked on at a time.
_CELLS = 1 << 20


def partial_ratio(a: Column | str, b: Column | str) -> Column:
    """Best ratio of the shorter text and a window of its length in the longer one.

    The windows are those that line up with a block both texts share, and the last one. Nearly
    equal counts as equal. Null or empty: 0.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    usable = (F.char_length(a) > 0) & (F.char_length(b) > 0)
    a_first = F.char_length(a) <= F.char_length(b)
    short, long = F.when(usable, F.when(a_first, a).otherwise(b)), F.when(usable, F.when(a_first, b).otherwise(a))
    size = F.char_length(short)
    windows = F.transform(_starts(short, long), lambda s: F.substring(long, s + 1, size))
    both = F.zip_with(windows, _shared(short, windows), lambda w, n: 2.0 * n / (size + F.char_length(w)))
    best = F.array_max(both)
    return F.when(best > 0.995, 100).when(best.isNotNull(), F.rint(100 * best).cast("int")).otherwise(0)


@F.pandas_udf(ArrayType(IntegerType()))
def _starts(short: pd.Series, long: pd.Series) -> pd.Series:
    """Where the windows begin, each once; null for null."""
    rows = np.flatnonzero(short.notna().to_numpy())
    a, b = short.to_numpy()[rows], long.to_numpy()[rows]
    found = [(at, np.maximum(0, j - i)) for at, i, j, _ in common_runs(a, b)]
    # The place behind the last block lines up with the end.
    last = np.maximum(0, _sizes(b) - _sizes(a))
    at, start = (np.concatenate(x) for x in zip(*found, (np.arange(len(rows)), last)))
    at, start = np.unique(np.stack([at, start]), axis=1).astype(int)
    cuts = np.split(start, np.searchsorted(at, np.arange(1, len(rows)))) if len(rows) else []
    out = np.full(len(short), None, dtype=object)
    out[rows] = _objects(cuts)
    return pd.Series(out)


@F.pandas_udf(ArrayType(IntegerType()))
def _shared(short: pd.Series, windows: pd.Series) -> pd.Series:
    """For every window the characters of the blocks it shares with the short text."""
    rows = np.flatnonzero(windows.notna().to_numpy())
    lists = windows.to_numpy()[rows]
    times = np.array([len(x) for x in lists], int)
    flat = np.concatenate(lists) if len(rows) else np.empty(0, object)
    total = np.zeros(len(flat), int)
    for at, _, _, size in common_runs(np.repeat(short.to_numpy()[rows], times), flat):
        np.add.at(total, at, size)
    out = np.full(len(windows), None, dtype=object)
    out[rows] = _objects(np.split(total, np.cumsum(times)[:-1]) if len(rows) else [])
    return pd.Series(out)


def _objects(parts: list) -> np.ndarray:
    out = np.empty(len(parts), dtype=object)
    for i, part in enumerate(parts):
        out[i] = part
    return out


def _sizes(texts: np.ndarray) -> np.ndarray:
    return np.fromiter(map(len, texts), int, len(texts))


def _codes(texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Code points as rows, filled up with -1."""
    out = np.full((len(texts), max(1, sizes.max(initial=1))), -1, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return out


def _frequent(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where a long text has a character that makes up more than a hundredth of it."""
    out = np.zeros(codes.shape, bool)
    rows = np.flatnonzero(sizes >= WHOLE_BELOW)
    r, c = np.nonzero(np.arange(codes.shape[1]) < sizes[rows, None])
    _, place, times = np.unique(r.astype(np.int64) << 32 | codes[rows[r], c], return_inverse=True, return_counts=True)
    out[rows[r], c] = times[place] > sizes[rows[r]] // 100 + 1
    return out


def common_runs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, place in a, place in b, length) of the blocks that ``a[row]`` and ``b[row]`` share.

    The longest run of each row, the first one in a and then in b, then the same to the left and
    to the right of it, until nothing is shared.
    """
    order = np.argsort(_sizes(b), kind="stable")
    at = 0
    while at < len(order):
        longest = len(b[order[-1]]) + 1
        rows = order[at:at + max(1, _CELLS // longest)]
        # Shorter texts come first: take as many as fit beside the longest of them.
        rows = rows if len(rows) == 1 else order[at:at + max(1, _CELLS // (len(b[rows[-1]]) + 1))]
        at += len(rows)
        la, lb = _sizes(a[rows]), _sizes(b[rows])
        ca, cb = _codes(a[rows], la), _codes(b[rows], lb)
        common = _frequent(cb, lb)
        zero = np.zeros(len(rows), int)
        open_ = np.stack([np.arange(len(rows)), zero, la, zero, lb])
        while open_.shape[1]:
            own, a0, a1, b0, b1 = open_
            i, j, size = _longest(ca[own], cb[own], common[own], a0, a1, b0, b1)
            hit = size > 0
            yield rows[own[hit]], i[hit], j[hit], size[hit]
            before = np.stack([own, a0, i, b0, j])[:, hit & (a0 < i) & (b0 < j)]
            after = np.stack([own, i + size, a1, j + size, b1])[:, hit & (i + size < a1) & (j + size < b1)]
            open_ = np.concatenate([before, after], axis=1)


def _longest(ca, cb, common, a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in a, place in b and length of the longest run of every row's stretch."""
    n, places = len(ca), np.arange(cb.shape[1])
    each = np.arange(n)
    seen = np.where((places >= b0[:, None]) & (places < b1[:, None]) & ~common, cb, -2)
    run = np.zeros((n, cb.shape[1] + 1), np.int32)
    i, j, size = a0.copy(), b0.copy(), np.zeros(n, int)
    for step in range(int((a1 - a0).max(initial=0))):
        here = a0 + step
        code = np.where(here < a1, ca[each, np.minimum(here, ca.shape[1] - 1)], -3)
        run[:, 1:] = np.where(seen == code[:, None], run[:, :-1] + 1, 0)
        end = run.argmax(axis=1)
        longest = run[each, end]
        better = longest > size
        size = np.where(better, longest, size)
        i, j = np.where(better, here - longest + 1, i), np.where(better, end - longest, j)
    # Frequent characters start no run but belong to one that reaches them.
    while (more := (i > a0) & (j > b0) & (ca[each, i - 1] == cb[each, j - 1])).any():
        i, j, size = i - more, j - more, size + more
    last_a, last_b = ca.shape[1] - 1, cb.shape[1] - 1
    while (more := (i + size < a1) & (j + size < b1) & (
            ca[each, np.minimum(i + size, last_a)] == cb[each, np.minimum(j + size, last_b)])).any():
        size = size + more
    return i, j, size

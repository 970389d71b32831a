"""Exact nearest neighbours of blocks of queries in blocks of points: tiles of bounded size, whatever the blocks' sizes.

A tile of all pairs of a few queries and a few thousand points is scored roughly, by one product in single precision, and
pairs that can't be among a query's k best, by more than the rounding's bound, are left out. What remains is scored in
double precision from the two vectors alone, so a pair's score doesn't depend on its place in a block, and equal vectors tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries and points of a tile; points that a query's first bound is taken from; pairs scored exactly at a time; rows of a batch that is passed on.
QUERIES, POINTS, FIRST, PAIRS, ROWS = 128, 8192, 1024, 1 << 14, 1 << 16
#: Dimensions up to which a product in double precision costs no more, and the largest value that single precision serves.
FEW_DIMS, LARGE = 8, 1e15
#: Points of a tile that is a box.
NEAR = 512
FOLDS = ("manhattan", "chebyshev", "minkowski")
ANGLES = ("cosine", "angular")
NONE = np.iinfo(np.int64).max


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the finite vectors of each length, in the precision that they have."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        own = column if len(at) == len(column) else column.take(pa.array(at))
        flat = own.flatten().to_numpy(zero_copy_only=False)
        matrix = (flat if flat.dtype in (np.float32, np.float64) else flat.astype(np.float64)).reshape(len(at), int(n))
        fine = np.isfinite(matrix).all(1)
        out.append((at, matrix) if fine.all() else (at[fine], matrix[fine]))
    return out


def first_copies(ids: np.ndarray, matrix: np.ndarray, most: int) -> np.ndarray | None:
    """Places of the rows that have one of the ``most`` lowest ids of their vector; None for all of them. Ties go by id, so no other copy is ever a hit."""
    if not len(ids) or not matrix.shape[1]:
        return None
    keys = np.ascontiguousarray(matrix).view(np.dtype((np.void, matrix.shape[1] * matrix.itemsize))).ravel()
    _, code, n = np.unique(keys, return_inverse=True, return_counts=True)
    if n.max() <= most:
        return None
    order = np.lexsort((ids, code))
    new_code = np.r_[True, np.diff(code[order]) != 0]
    step = np.cumsum(new_code | np.r_[True, np.diff(ids[order]) != 0])
    starts = np.maximum.accumulate(np.where(new_code, step, 0))
    return np.sort(order[step - starts < most])


def boxes(matrix: np.ndarray, most: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Places of the rows in tiles of ``most`` at most, halved in their widest dimension, and each tile's least and highest values."""
    out, left = [], [np.arange(len(matrix))]
    while left:
        at = left.pop()
        if len(at) <= most:
            out.append(at)
            continue
        part, half = matrix[at], len(at) // 2
        order = np.argpartition(part[:, int(np.ptp(part, axis=0).argmax())], half)
        left += [at[order[:half]], at[order[half:]]]
    low, high = (np.stack([f(matrix[at].astype(np.float64), axis=0) for at in out]) for f in (np.min, np.max))
    return out, low, high


def pair_scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The score of each row of ``a`` with the same row of ``b``, in double precision."""
    if metric in FOLDS:
        gaps = np.abs(a - b)
        return 1.0 - {"manhattan": lambda: gaps.sum(1), "chebyshev": lambda: gaps.max(1, initial=0.0), "minkowski": lambda: (gaps**3.0).sum(1) ** (1 / 3.0)}[metric]()
    if metric in ("euclidean", "squared_euclidean"):
        squared = ((a - b) ** 2).sum(1)
        return 1.0 - (np.sqrt(squared) if metric == "euclidean" else squared)
    product = (a * b).sum(1)
    if metric in ("dot_product", "max_inner_product"):
        return 1.0 + product
    scale = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    similar = np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)
    return similar if metric == "cosine" else 1.0 - np.arccos(np.clip(similar, -1, 1))


class _Side:
    """What the rough scores need of some rows: the values, in single precision where it serves, and their sizes."""

    def __init__(self, matrix: np.ndarray, metric: str, kind: type):
        exact = matrix.astype(np.float64)
        self.exact = exact
        self.squares = (exact * exact).sum(1)
        self.size = np.sqrt(self.squares)
        if metric in ANGLES:
            exact = np.divide(exact, self.size[:, None], out=np.zeros_like(exact), where=self.size[:, None] > 0)
        elif metric in FOLDS:
            self.size = np.abs(exact).sum(1) if metric == "manhattan" else np.abs(exact).max(1, initial=0.0)
        self.rough = exact.astype(kind)
        if metric in FOLDS:
            self.rough = np.ascontiguousarray(self.rough.T)


def _rough(q: _Side, p: _Side, metric: str) -> np.ndarray:
    """Rough scores of all pairs; higher is better, in the terms of ``_bounds``."""
    if metric in FOLDS:
        out = np.zeros((q.rough.shape[1], p.rough.shape[1]), q.rough.dtype)
        for lo in range(0, len(out), 16):
            own, gap = out[lo : lo + 16], np.empty_like(out[lo : lo + 16])
            for x, y in zip(q.rough[:, lo : lo + 16], p.rough, strict=True):
                np.abs(np.subtract(y[None], x[:, None], out=gap), out=gap)
                if metric == "chebyshev":
                    np.maximum(own, gap, out=own)
                else:
                    own += gap if metric == "manhattan" else gap * gap * gap
        return np.negative(out, out=out)
    product = q.rough @ p.rough.T
    if metric in ("euclidean", "squared_euclidean"):
        product -= (p.squares / 2).astype(product.dtype)[None]
    return product


def _margin(q: _Side, p: _Side, metric: str) -> np.ndarray:
    """For each query what a rough score may be off by, for any of the points."""
    dims = q.exact.shape[1]
    unit = float(np.finfo(q.rough.dtype).eps)
    off = (dims + 16) * unit
    most = p.size.max(initial=0.0)
    if metric in ANGLES:
        bound = np.full(len(q.size), off)
    elif metric == "minkowski":
        bound = dims * off * (q.size + most) ** 3
    elif metric in FOLDS:
        bound = off * (q.size + most)
    elif metric in ("dot_product", "max_inner_product"):
        bound = off * q.size * most
    else:
        bound = off * (q.size + most) * most
    return 2 * bound + (dims + 1) * 1e-37 + 1e-14 * (metric in ANGLES)


def _bounds(scores: np.ndarray, q: _Side, metric: str) -> np.ndarray:
    """The rough score that a pair needs for an exact score, or for one that rounds to it."""
    if metric == "cosine":
        return scores
    if metric == "angular":
        return np.where(np.isfinite(scores), np.cos(np.clip(1.0 - scores, 0, np.pi)), -np.inf)
    if metric in ("dot_product", "max_inner_product"):
        return scores - 1.0 - 4e-16 * (1 + np.abs(scores))
    far = np.maximum(1.0 - scores, 0)
    far = far + 4e-16 * (1 + far)
    if metric in FOLDS:
        return -(far**3 * (1 + 1e-14)) if metric == "minkowski" else -far
    return (q.squares - (far if metric == "squared_euclidean" else far**2 * (1 + 1e-14))) / 2


class Best:
    """The k best points of each of a block of queries, of the points added so far. It holds the queries, k hits of each, and a tile.

    ``unequal`` is the score of vectors of unequal lengths. Vectors that aren't finite have no hits and are none.
    """

    def __init__(self, q_ids: np.ndarray, queries: pa.Array, k: int, metric: str, unequal: float, skip_self: bool = False):
        self.q_ids, self.parts, self.k, self.metric, self.unequal, self.skip_self = q_ids, matrices(queries), k, metric, unequal, skip_self
        self.boxes: dict[int, tuple] = {}
        self.ids = np.full((len(q_ids), k), NONE)
        self.scores = np.full((len(q_ids), k), -np.inf)

    def add(self, ids: np.ndarray, points: pa.Array) -> None:
        if not self.k:
            return
        groups = matrices(points)
        for p_at, p in groups:
            own = ids[p_at]
            few = first_copies(own, p, self.k + self.skip_self)
            if few is not None:
                own, p = own[few], p[few]
            for q_at, q in self.parts:
                if q.shape[1] == p.shape[1]:
                    self._equal(q_at, q, own, p)
                else:
                    self._unequal(q_at, own)

    def _unequal(self, q_at: np.ndarray, ids: np.ndarray) -> None:
        """Their scores are all the same, so the lowest ids count."""
        low = np.unique(ids)[: self.k + 1]
        low = np.sort(ids[ids <= low[-1]]) if len(low) else low
        for lo in range(0, len(q_at), QUERIES):
            at = q_at[lo : lo + QUERIES]
            rows, columns = np.repeat(np.arange(len(at)), len(low)), np.tile(np.arange(len(low)), len(at))
            self._merge(at, rows, low[columns], np.full(len(rows), self.unequal))

    def _near(self, q_at: np.ndarray, q: np.ndarray, ids: np.ndarray, p: np.ndarray) -> None:
        """In few dimensions tiles are boxes, and a tile of queries meets those that aren't farther than its hits, nearest first."""
        if q.shape[1] not in self.boxes:
            self.boxes[q.shape[1]] = boxes(q, QUERIES)
        q_tiles, q_low, q_high = self.boxes[q.shape[1]]
        p_tiles, p_low, p_high = boxes(p, NEAR)
        sides = [(ids[at], _Side(p[at], self.metric, np.float64)) for at in p_tiles]
        for tile, low, high in zip(q_tiles, q_low, q_high, strict=True):
            gaps = (np.maximum(0, np.maximum(p_low - high, low - p_high)) ** 2).sum(1)
            at, own = q_at[tile], None
            for j in np.argsort(gaps):
                far = 1.0 - self.scores[at, -1].min()
                far += 4e-16 * (1 + far)
                if gaps[j] > (far if self.metric == "squared_euclidean" else far**2) * (1 + 1e-12):
                    break
                own = own or _Side(q[tile], self.metric, np.float64)
                self._tile(at, own, *sides[j])

    def _equal(self, q_at: np.ndarray, q: np.ndarray, ids: np.ndarray, p: np.ndarray) -> None:
        if not len(p) or not len(q):
            return
        if 0 < q.shape[1] <= FEW_DIMS and self.metric in ("euclidean", "squared_euclidean"):
            self._near(q_at, q, ids, p)
            return
        large = max(np.abs(x).max(initial=0.0) for x in (q, p))
        kind = np.float32 if q.shape[1] > FEW_DIMS and large < LARGE else np.float64
        for lo in range(0, len(p), POINTS):
            side, own = _Side(p[lo : lo + POINTS], self.metric, kind), ids[lo : lo + POINTS]
            for at in range(0, len(q), QUERIES):
                self._tile(q_at[at : at + QUERIES], _Side(q[at : at + QUERIES], self.metric, kind), own, side)

    def _tile(self, at: np.ndarray, q: _Side, ids: np.ndarray, p: _Side) -> None:
        rough = _rough(q, p, self.metric)
        last = self.scores[at, -1]
        new = np.flatnonzero(np.isneginf(last))
        if len(new):
            last[new] = self._first(at[new], rough[new, : max(FIRST, 2 * self.k)], q.exact[new], ids, p)
        least = _bounds(last, q, self.metric) - _margin(q, p, self.metric)
        # What isn't a number isn't below either, so it is looked at.
        found = np.flatnonzero(~(rough < np.nextafter(least.astype(rough.dtype), -np.inf, dtype=rough.dtype)[:, None]))
        if not len(found):
            return
        rows, columns = np.divmod(found, rough.shape[1])
        if self.skip_self:
            other = ids[columns] != self.q_ids[at[rows]]
            rows, columns = rows[other], columns[other]
        scores = np.empty(len(rows))
        for lo in range(0, len(rows), PAIRS):
            scores[lo : lo + PAIRS] = pair_scores(q.exact[rows[lo : lo + PAIRS]], p.exact[columns[lo : lo + PAIRS]], self.metric)
        # A score that is less than the last of k can't enter.
        better = np.isfinite(scores) & (scores >= self.scores[at[rows], -1])
        self._merge(at, rows[better], ids[columns[better]], scores[better])

    def _first(self, at: np.ndarray, rough: np.ndarray, exact: np.ndarray, ids: np.ndarray, p: _Side) -> np.ndarray:
        """For queries without k hits, the least score of k of the tile's points that look best: k hits have at least that."""
        place = rough.shape[1] - self.k
        if place < 0:
            return np.full(len(at), -np.inf)
        if self.skip_self:
            rough = np.where(ids[None, : rough.shape[1]] == self.q_ids[at][:, None], -np.inf, rough)
        out = np.full(len(at), np.inf)
        for column in np.argpartition(rough, place, axis=1)[:, place:].T:
            score = pair_scores(exact, p.exact[column], self.metric)
            mine = np.isneginf(rough[np.arange(len(at)), column]) | ~np.isfinite(score)
            out = np.minimum(out, np.where(mine, -np.inf, score))
        return out

    def _merge(self, at: np.ndarray, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``rows``, in order, are places in ``at``."""
        if self.skip_self:
            other = ids != self.q_ids[at[rows]]
            rows, ids, scores = rows[other], ids[other], scores[other]
        if not len(rows):
            return
        touched = np.unique(rows)
        own = at[touched]
        all_rows = np.concatenate([np.repeat(touched, self.k), rows])
        all_ids, all_scores = np.concatenate([self.ids[own].ravel(), ids]), np.concatenate([self.scores[own].ravel(), scores])
        order = np.lexsort((all_ids, -all_scores, all_rows))
        take = order[np.searchsorted(all_rows[order], touched)[:, None] + np.arange(self.k)]
        self.ids[own], self.scores[own] = all_ids[take], all_scores[take]

    def batches(self) -> Iterator[pa.RecordBatch]:
        """(query_id, id, score) of all hits."""
        if not self.k:
            return
        step = max(1, ROWS // self.k)
        for lo in range(0, len(self.q_ids), step):
            rows, columns = np.nonzero(np.isfinite(self.scores[lo : lo + step]))
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.q_ids[lo + rows], self.ids[lo + rows, columns], self.scores[lo + rows, columns])], names=["query_id", "id", "score"])

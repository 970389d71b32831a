"""Operator 5: contiguous shards of least greatest size (minimax partition) over ordered atomic groups.

The least capacity is found by binary search, each capacity checked greedily: a shard takes groups until the next would
exceed it. The driver never holds the group sizes. It knows some group borders, as prefix sums of the sizes, and which
gaps between known borders may hide others. Within a gap a greedy cut lies between two bounds, and so does the least
capacity; only the stretches in which these bounds differ are read again, at a finer step, until both agree exactly.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.common import prefix_sums

SHARDS = 32
#: Borders learned in one pass, about; bounds the driver's memory, not the result.
POINTS = 200_000


class _Borders:
    """Known borders (prefix sums) and, for each gap to the next one, whether it may hide others."""

    def __init__(self, total: int):
        self.points = np.array([0, total], np.int64)
        self.hidden = np.array([total > 1, False])

    def learn(self, rows: list[tuple[int, int, int]], windows: list[tuple[int, int]]) -> None:
        """``rows``: first and last border and number of rows of each step within ``windows``, which they cover."""
        los, his = (np.array(x, np.int64) for x in zip(*windows, strict=True))
        first, last, n = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        points = np.unique(np.concatenate([self.points, first, last]))
        # A window is a whole gap, so what lies between its new borders was seen, but within a step only both ends.
        at = np.searchsorted(self.points, points, "right") - 1
        ends = np.append(points[1:], points[-1])
        w = np.searchsorted(los, points + 1, "right") - 1
        hidden = self.hidden[at] & ~((w >= 0) & (ends - 1 <= his[np.maximum(w, 0)]))
        more = (last > first + 1) & (n > 2)
        hidden[np.searchsorted(points, first[more])] = True
        self.points, self.hidden = points, hidden & (ends > points + 1)

    def path(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Greedy cuts; in a gap that may hide borders the lowest, or if ``hopeful`` the highest, that is possible."""
        out, at, total = [], 0, int(self.points[-1])
        for _ in range(shards):
            to = at + capacity
            if to >= total:
                out.append(total)
                break
            j = int(np.searchsorted(self.points, to, "right")) - 1
            at = to if hopeful and self.hidden[j] else int(self.points[j])
            out.append(at)
        return out

    def least(self, shards: int, hopeful: bool) -> int:
        """The least capacity whose path reaches the end."""
        total = int(self.points[-1])
        lo, hi = -(-total // shards), total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.path(mid, shards, hopeful)[-1] == total:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def unsure(self, lo: int, hi: int, shards: int) -> list[tuple[int, int]]:
        """The gaps with hidden borders in which a cut may fall, for capacities from ``lo`` to ``hi``."""
        low, high = self.path(lo, shards, False), self.path(hi, shards, True)
        total, found, a, b = int(self.points[-1]), set(), 0, 0
        for k in range(shards):
            start, end = a + lo, min(b + hi, total)
            if start < total:
                i, j = (int(np.searchsorted(self.points, x, "right")) - 1 for x in (start, end))
                found.update((np.flatnonzero(self.hidden[i : j + 1]) + i).tolist())
            a, b = low[min(k, len(low) - 1)], high[min(k, len(high) - 1)]
        return [(int(self.points[g]) + 1, int(self.points[g + 1]) - 1) for g in sorted(found)]


def _read(prefix: DataFrame, windows: list[tuple[int, int]], points: int) -> list[tuple[int, int, int]]:
    step = max(1, sum(y - x + 1 for x, y in windows) // points)
    los, his = (np.array(x, np.int64) for x in zip(*windows, strict=True))

    def part(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            e = batch.column(0).to_numpy()
            w = np.searchsorted(los, e, "right") - 1
            inside = (w >= 0) & (e <= his[np.maximum(w, 0)])
            e, w = e[inside], w[inside]
            if not len(e):
                continue
            # Steps don't reach from one window into another.
            order = np.lexsort((e, w))
            e, w = e[order], w[order]
            starts = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (e[1:] // step != e[:-1] // step)])
            ends = np.r_[starts[1:], len(e)]
            yield pa.RecordBatch.from_arrays([pa.array(w[starts]), pa.array(e[starts] // step), pa.array(e[starts]), pa.array(e[ends - 1]), pa.array(ends - starts)], names=["w", "s", "a", "b", "n"])

    seen = prefix.select((F.col("before") + F.col("size")).alias("e")).mapInArrow(part, "w bigint, s bigint, a bigint, b bigint, n bigint")
    rows = seen.groupBy("w", "s").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    table = rows.select("a", "b", "n").toArrow()
    return list(zip(*(table.column(c).to_pylist() for c in "abn"), strict=True))


def minimax_cuts(prefix: DataFrame, total: int, shards: int, points: int = POINTS) -> tuple[int, list[int]]:
    """The least capacity and the greedy cuts at it, as prefix sums of (before, size)."""
    if shards < 1:
        raise ValueError("at least one shard")
    known = _Borders(total)
    while True:
        lo, hi = known.least(shards, True), known.least(shards, False)
        if lo == hi and (cuts := known.path(lo, shards, False)) == known.path(lo, shards, True):
            return lo, cuts
        windows = known.unsure(lo, hi, shards)
        known.learn(_read(prefix, windows, points), windows)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", points: int = POINTS) -> DataFrame:
    """(doc_id, size, shard): contiguous shards by doc_id, the largest of them as small as can be.

    Rows of one doc_id are one atomic group, of null too, which comes first; its size is the bytes of its texts, 0 for
    null and empty ones. Shards are filled greedily up to the least capacity, so the last ones can be smaller, or left
    out when fewer suffice. A group of size 0 goes with the one before it. An empty table gives no rows; other columns
    aren't read.
    """
    sizes = docs.groupBy(F.col(id_col).alias("doc_id")).agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).cast("bigint").alias("size"))
    prefix = prefix_sums(sizes, [], ["doc_id"], "size", "sizes")
    total = prefix.agg(F.max(F.col("before") + F.col("size"))).first()[0] or 0
    _, cuts = minimax_cuts(prefix, total, shards, points)
    borders = np.array(cuts, np.int64)
    schema = T.StructType([prefix.schema["doc_id"], T.StructField("size", T.LongType()), T.StructField("shard", T.IntegerType())])

    def assign(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            ends = batch.column(2).to_numpy() + batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.searchsorted(borders, ends, "left").astype(np.int32))], names=schema.names)

    return prefix.select("doc_id", "size", "before").mapInArrow(assign, schema)


SQL_SHARD = f"""
WITH RECURSIVE groups_ AS (
  SELECT doc_id, coalesce(sum(strlen(text)), 0)::BIGINT AS size FROM documents GROUP BY doc_id
), ends AS (
  SELECT doc_id, size, (sum(size) OVER (ORDER BY doc_id NULLS FIRST))::BIGINT AS e FROM groups_
), whole AS (
  SELECT list(size ORDER BY doc_id NULLS FIRST) AS sizes, sum(size)::BIGINT AS total, max(size)::BIGINT AS most FROM groups_
), search AS (
  SELECT greatest(most, (total + {SHARDS - 1}) // {SHARDS}) AS lo, total AS hi FROM whole
  UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT lo, hi, mid, (list_reduce(list_prepend(0::BIGINT, sizes), lambda acc, x: CASE WHEN (acc & 1099511627775) + x <= mid THEN acc + x ELSE (((acc >> 40) + 1) << 40) + x END) >> 40) + 1 <= {SHARDS} AS ok
    FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM search WHERE lo < hi), whole)
), best AS (SELECT min(hi) AS c FROM search), cuts AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS c0
  UNION ALL
  SELECT k + 1, max(e) FROM cuts, best, ends, whole WHERE c0 < total AND e <= c0 + c GROUP BY k
)
SELECT doc_id, size, ((SELECT count(*) FROM cuts WHERE k > 0 AND c0 < e))::INTEGER AS shard FROM ends
"""

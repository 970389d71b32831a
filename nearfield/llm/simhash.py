"""Operator 9: near duplicates by SimHash, found with a hierarchical index over fingerprints in Gray order.

A document's fingerprint is two times 64 bits, each the signs of a weighted vote of its distinct words. Documents are
near copies if the first 64 bits differ in at most ``RADIUS`` places and the others in at most ``CONFIRM``.

The first half is cut into ``radius`` + k parts, of which near fingerprints agree in k at least; they meet in the bucket
of each k parts in which they agree, so no pair is lost. k is 2 (45 tables, keys of 13 bits) up to some 10^8 distinct
fingerprints, and more beyond, so buckets stay small; the result is the same with any. A bucket's fingerprints are sorted by Gray rank, which puts those with long shared patterns side by side, and indexed bottom-up: a node keeps the
bits all below it share, masked by those that its parent has already. A search adds up differences on its way down and
drops a node, with the whole group below it, once they exceed the radius. Every fingerprint is a query; there is no cap.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import components, digest, keep, partitions, slices, without

RADIUS = 8
CONFIRM = 12
#: Members of a node of the index.
FAN_OUT = 8
#: Rows of the index built at once (whole buckets), and pairs of query and node held at once; neither changes the result.
ROWS = 1 << 17
FRONTIER = 1 << 21
#: Fingerprints in a bucket, expected, beyond which one more part has to agree.
BUCKET = 1 << 15

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def fingerprints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints (n x 2, uint64) and numbers of distinct words of texts, lower-cased.

    Words are runs of ASCII letters, digits and all characters beyond ASCII. A word that occurs n times votes with
    weight round(8 log(1 + n)). Texts without words, and null, have 0 words and no meaningful fingerprint.
    """
    coded = [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    starts_of = np.cumsum([0, *[len(c) + 1 for c in coded]])
    word = np.zeros(len(joined) + 1, np.int8)
    word[1:] = _IS_WORD[joined]
    edge = np.diff(word, append=np.int8(0))
    begin, end = np.flatnonzero(edge[:-1] == 1), np.flatnonzero(edge == -1)
    end = end[: len(begin)]
    powers = _powers(len(joined) + 1, _FACTOR)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    hashed = _mix((sums[end] - sums[begin]) * _powers(len(joined) + 1, _INVERSE)[begin])
    doc = np.searchsorted(starts_of, begin, "right") - 1
    out, words = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), np.int64)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d in range(len(texts)):
        own = np.sort(hashed[bounds[d] : bounds[d + 1]])
        if not len(own):
            continue
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        count = np.diff(np.r_[first, len(own)])
        own = own[first]
        weight = np.rint(8 * np.log1p(count))
        weight = weight.astype(np.float32 if len(own) < 50_000 else np.float64)
        half = weight.sum() / 2
        for k, seed in enumerate((0, 0x5851F42D4C957F2D)):
            bits = np.unpackbits(_mix(own + np.uint64(seed)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            out[d, k] = np.packbits(weight @ bits.astype(weight.dtype) > half, bitorder="little").view(np.uint64)[0]
        words[d] = len(own)
    return out, words


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, f1, f2) of each row with words in its text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                found, words = fingerprints(part.column(2).to_pylist())
                some = pa.array(words > 0)
                own = [part.column(0), part.column(1), pa.array(found[:, 0].view(np.int64)), pa.array(found[:, 1].view(np.int64))]
                yield pa.RecordBatch.from_arrays([c.filter(some) for c in own], names=["doc_id", "digest", "f1", "f2"])

    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, digest bigint, f1 bigint, f2 bigint")


def gray_rank(f: Column) -> Column:
    """Place of a fingerprint in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        f = f.bitwiseXOR(F.shiftrightunsigned(f, shift))
    return f


def agreeing_parts(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> int:
    """The number of parts that make a key, for n distinct fingerprints."""
    k = 2
    while k < 4 and n >> (64 * k // (radius + k)) > bucket:
        k += 1
    return k


def parts_of(radius: int, k: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(first bit, bits) of each part, and the parts of each table's key, in lexicographic order."""
    p = radius + k
    cuts = [64 * i // p for i in range(p + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], list(combinations(range(p), k))


class GrayIndex:
    """The index over fingerprints that are sorted by (bucket, Gray rank), with a tree for each bucket."""

    def __init__(self, prints: np.ndarray, bucket: np.ndarray):
        self.prints = prints
        change = np.r_[True, bucket[1:] != bucket[:-1]]
        roots = int(change.sum())
        #: By level, leaves first: bits shared, their values, first child and row after the last.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        every, some, of, end = prints, prints, np.cumsum(change) - 1, np.arange(1, len(prints) + 1)
        self.levels.append((np.full(len(prints), ~np.uint64(0)), prints, np.arange(len(prints)), end))
        self.bucket = of
        while len(every) > roots:
            new = np.r_[True, of[1:] != of[:-1]]
            at = np.arange(len(of))
            start = np.flatnonzero(new | ((at - at[new][np.cumsum(new) - 1]) % FAN_OUT == 0))
            every, some = np.bitwise_and.reduceat(every, start), np.bitwise_or.reduceat(some, start)
            last = np.r_[start[1:], len(of)] - 1
            of, end = of[start], end[last]
            shared = ~(every ^ some)
            self.levels.append((shared, every & shared, start, end))

    def _down(self, level: int, q: np.ndarray, node: np.ndarray, far: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not len(q):
            return
        if level == 0:
            yield q, node
            return
        if len(q) * FAN_OUT > FRONTIER and len(q) > 1:
            half = len(q) // 2
            yield from self._down(level, q[:half], node[:half], far[:half], radius)
            yield from self._down(level, q[half:], node[half:], far[half:], radius)
            return
        shared, _, first, _ = self.levels[level]
        below, value, _, end = self.levels[level - 1]
        stop = np.r_[first[1:], len(below)]
        times = stop[node] - first[node]
        child = np.repeat(first[node] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
        q, parent, far = np.repeat(q, times), np.repeat(node, times), np.repeat(far, times)
        ahead = end[child] > q + 1  # the pairs of a query with later rows
        q, parent, far, child = q[ahead], parent[ahead], far[ahead], child[ahead]
        far = far + np.bitwise_count((self.prints[q] ^ value[child]) & below[child] & ~shared[parent])
        near = far <= radius
        yield from self._down(level - 1, q[near], child[near], far[near], radius)

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows of a bucket, the earlier first, that differ in at most ``radius`` bits."""
        top = len(self.levels) - 1
        shared, value, _, _ = self.levels[top]
        q = np.arange(len(self.prints))
        node = self.bucket if top else q
        far = np.bitwise_count((self.prints ^ value[node]) & shared[node]).astype(np.int16)
        if not top:
            return
        for a, b in self._down(top, q, node, far, radius):
            yield a, b


def _linked(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the least row that it is linked with."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(root[a], root[b])
            if (root[a] == low).all() and (root[b] == low).all():
                break
            for x in (root[a], root[b], a, b):
                np.minimum.at(root, x, low)
            root = root[root]
    while (root[root] != root).any():
        root = root[root]
    return root


def _edges(key: np.ndarray, f1: np.ndarray, f2: np.ndarray, node: np.ndarray, radius: int, confirm: int, k: int) -> pa.RecordBatch:
    parts, tables = parts_of(radius, k)
    masks = np.array([((1 << n) - 1) << at for at, n in parts], np.uint64)
    chosen = np.array(tables)
    table = key >> 32

    def accepted():
        for a, b in GrayIndex(f1, key).pairs(radius):
            ok = np.bitwise_count(f2[a] ^ f2[b]) <= confirm
            a, b = a[ok], b[ok]
            agree = ((f1[a] ^ f1[b])[:, None] & masks) == 0
            first = np.empty((len(a), k), np.int64)
            for i in range(k):
                first[:, i] = agree.argmax(1)
                agree[np.arange(len(a)), first[:, i]] = False
            # A pair that meets in several buckets counts in the first.
            once = (chosen[table[a]] == first).all(1)
            yield a[once], b[once]

    root = _linked(len(key), accepted())
    rows = np.flatnonzero(root != np.arange(len(key)))
    return pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(node[root[rows]])], names=["a", "b"])


def near_edges(nodes: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM, k: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the near ones of the distinct fingerprints (node, f1, f2); k parts make a key."""
    k = k or agreeing_parts(nodes.count(), radius)
    parts, tables = parts_of(radius, k)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            rows += batch.num_rows
            if rows < ROWS:
                continue
            whole = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(whole[0], whole[0, -1]))  # the last bucket can go on
            held, rows = [whole[:, cut:]], whole.shape[1] - cut
            if cut:
                yield run(whole[:, :cut])
        if rows:
            yield run(np.concatenate(held, axis=1))

    def run(columns: np.ndarray) -> pa.RecordBatch:
        key, f1, f2, node = np.ascontiguousarray(columns)
        return _edges(key, f1.view(np.uint64), f2.view(np.uint64), node, radius, confirm, k)

    def table_key(t: int, chosen: tuple[int, ...]) -> Column:
        key, room = F.lit(t << 32), 32
        for i in chosen:
            at, n = parts[i]
            room -= n
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("f1", at).bitwiseAND(F.lit((1 << n) - 1)), room))
        return key

    keys = [table_key(t, chosen) for t, chosen in enumerate(tables)]
    spread = nodes.select(F.explode(F.array(*keys)).alias("key"), "f1", "f2", "node")
    placed = spread.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", gray_rank(F.col("f1")))
    return placed.mapInArrow(search, "a bigint, b bigint")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """(doc_id, digest, n, keeper_id, keeper_digest): units, the n rows of one doc_id and text, in groups of two rows or more."""
    seen = keep(signatures(docs, id_col, text_col), "signatures")
    units = seen.groupBy("doc_id", "digest").agg(F.first("f1").alias("f1"), F.first("f2").alias("f2"), F.count(F.lit(1)).alias("n"))
    units = keep(units, "units")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("best")
    nodes = units.groupBy("f1", "f2").agg(best, F.sum("n").alias("rows")).withColumn("node", F.monotonically_increasing_id())
    nodes = keep(nodes, "fingerprints")
    roots = components(near_edges(nodes, radius, confirm))
    grouped = nodes.join(roots, "node", "left").filter("root IS NOT NULL OR rows > 1").withColumn("root", F.coalesce("root", "node"))
    grouped = keep(grouped.select("f1", "f2", "root", "best"), "grouped")
    chosen = grouped.groupBy("root").agg(F.min("best").alias("best"))
    of = grouped.select("f1", "f2", "root").join(chosen, "root").select("f1", "f2", "best")
    return units.join(of, ["f1", "f2"]).select("doc_id", "digest", "n", F.col("best.doc_id").alias("keeper_id"), F.col("best.digest").alias("keeper_digest"))


def _is_keeper() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("keeper_id")) & (F.col("digest") == F.col("keeper_digest"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """(doc_id, copy_of): one row for each document that another one of its group of near copies replaces.

    Groups are the connected components of near pairs; the smallest doc_id stays (null last, ties by a hash of the
    text). Null and empty texts, and those without any word, are in no group. A repeated row is a copy of itself:
    (7, 7), once for each repetition. An empty table gives no rows; other columns aren't read.
    """
    found = groups(docs, id_col, text_col, radius, confirm)
    times = F.col("n") - _is_keeper().cast("int")
    return found.select("doc_id", F.col("keeper_id").alias("copy_of"), F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("one")).drop("one")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, confirm: int = CONFIRM) -> DataFrame:
    """The rows of ``docs`` with one document of each group of near copies, all columns; see ``near_duplicates``."""
    found = groups(docs, id_col, text_col, radius, confirm).filter(~_is_keeper() | (F.col("n") > 1))
    return without(docs, keep(found.select("doc_id", "digest", _is_keeper().alias("one")), "marks"), id_col, text_col)

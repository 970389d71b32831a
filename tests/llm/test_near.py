import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from nearfield.llm import common, simhash
from nearfield.llm.common import table
from tests.oracle import SF

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
M = (1 << 64) - 1


def mix(h):
    h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD & M
    h = (h ^ (h >> 33)) * 0xC4CEB9FE1A85EC53 & M
    return h ^ (h >> 33)


def brute_print(text):
    """The definition, a word and a bit at a time."""
    words = Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()))
    votes = np.zeros((2, 64))
    for word, n in words.items():
        h = mix(sum((b + 1) * pow(simhash._FACTOR, i, 1 << 64) for i, b in enumerate(word)) & M)
        for k, seed in enumerate((0, 0x5851F42D4C957F2D)):
            v = mix((h + seed) & M)
            votes[k] += [round(8 * math.log1p(n)) * (1 if v >> i & 1 else -1) for i in range(64)]
    return [sum(1 << i for i in range(64) if row[i] > 0) for row in votes], len(words)


def brute_groups(rows):
    prints = {i: p for i, (_, text) in enumerate(rows) for p, n in [brute_print(text)] if n}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    keys = list(prints)
    for a in keys:
        for b in keys:
            if b < a and (prints[a][0] ^ prints[b][0]).bit_count() <= simhash.RADIUS and (prints[a][1] ^ prints[b][1]).bit_count() <= simhash.CONFIRM:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in keys}


def test_fingerprints():
    texts = ["", None, "a", "One two, two THREE!", "ñandú über ñandú", "x-y_z 1", "...", "w " * 100_000 + "v", " ".join(map(str, range(3000)))]
    got, words = simhash.fingerprints(texts)
    for text, print_, n in zip(texts, got.tolist(), words.tolist(), strict=True):
        want, count = brute_print(text)
        assert n == count and (not n or print_ == want)


@pytest.mark.parametrize("seed", range(6))
def test_index_is_brute_force(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 12).view(np.uint64)
    f = centres[rng.integers(0, 12, 600)]
    for _ in range(seed + 2):
        f = f ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    bucket = np.sort(rng.integers(0, (1, 5, 300)[seed % 3], 600))
    gray = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(s)
    order = np.lexsort((gray, bucket))
    f = f[order]
    got = {(int(x), int(y)) for a, b in simhash.GrayIndex(f, bucket).pairs(8) for x, y in zip(a, b, strict=True)}
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if bucket[i] == bucket[j] and int(f[i] ^ f[j]).bit_count() <= 8}
    assert got == want


@pytest.mark.parametrize(("k", "radius"), [(2, 8), (3, 8), (2, 3)])
def test_no_pair_is_lost(spark, k, radius):
    """Pairs at the radius exactly, their bits spread evenly, found by any number of agreeing parts; none beyond it."""
    rng = np.random.default_rng(k)
    rows = []
    for _ in range(150):
        f = int(rng.integers(0, 1 << 63))
        rows.append(f)
        for far in (radius, radius + 1):
            g = f
            for bit in rng.permutation(64)[:far] if rng.random() < 0.5 else [int(64 * (i + rng.random()) / far) for i in range(far)]:
                g ^= 1 << int(bit)
            rows.append(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in rows]
    nodes = spark.createDataFrame([(i, f, 5) for i, f in enumerate(signed)], "node bigint, f1 bigint, f2 bigint")
    root = {r.node: r.root for r in common.components(simhash.near_edges(nodes, radius=radius, k=k)).collect()}
    for i, f in enumerate(rows):
        for j in range(i):
            near = (f ^ rows[j]).bit_count() <= radius
            assert not near or root[i] == root[j]
    assert len(set(root.values())) >= 140


def test_parts_grow_with_the_fingerprints():
    assert [simhash.agreeing_parts(n) for n in (0, 10**6, 10**8, 10**9, 10**12)] == [2, 2, 2, 3, 4]
    parts, tables = simhash.parts_of(8, 2)
    assert len(tables) == 45 and sum(n for _, n in parts) == 64 and parts[0] == (0, 6)


def test_frontier_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    test_index_is_brute_force(1)


def near_text(rng, n=150):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_groups_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for g in range(60):
        base = near_text(rng)
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", None, "...", rows[0][1], "solo"])]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    want = {i: r for i, r in brute_groups(rows).items() if i != r}
    got = {r.doc_id: r.copy_of for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    left = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert left == {i for i, _ in rows} - set(got)


def test_recall_on_documents(spark):
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    want = {rows[i][0]: rows[r][0] for i, r in brute_groups(rows).items() if i != r}
    got = {r.doc_id: r.copy_of for r in simhash.near_duplicates(docs).collect()}
    assert len(want) > 5 and got == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "alpha beta gamma", "k"), (1, "alpha beta gamma", "k"), (2, "Alpha, beta: gamma", "l"), (None, "alpha beta gamma!", "m"), (3, None, "n"), (4, "", "o"), (5, "", "p"), (None, long, "q"), (7, long, "r"), (7, long + " x", "s")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, digest string, f1 int, one int")
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (None, 1), (7, 7), (None, 7)], key=str)
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)[:5]) for r in left.collect()) == [("1", "alpha"), ("3", "None"), ("4", ""), ("5", ""), ("7", "w0 w1")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}, 300: 300, 301: 300}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

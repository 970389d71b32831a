"""Operator 3: personal identifiers by bootstrapped contextual extraction.

A mention is a token with a digit or an @ in it (a telephone number, or a card number in groups: several), or each such
piece of a token cut at commas, colons, quotes, brackets and the like. Entities that pass a strict validator of
their kind seed the search; those that a validator refutes, as a card number of wrong check digit, are never accepted.
Each mention has lexical patterns: its shape, its coarse shape, the coarse shape with the words on its left or right,
and the words around it whatever its shape. Spark scores the graph of patterns and instances in rounds: a pattern is as
good as the share of its instances that are known to be of one kind. Patterns of enough support and confidence make
their unseen instances known, each as good as the best of them; those raise further patterns. What is known stays known,
so the rounds come to an end where nothing new is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import drop_kept, keep, slices

KINDS = ("email", "ip", "card", "phone", "secret")
#: A pattern counts if at least so many known instances fit it, and they are so large a share of all that do.
SUPPORT, CONFIDENCE = 5, 0.8
#: Mentions that are passed on at once; bounds memory, not the result.
HELD = 1 << 15
#: Characters beyond which a pattern is told by a hash of it.
PATTERN_LENGTH = 160

_ANCHOR = re.compile(r"[0-9@]")
_BLANK = re.compile(r"\s")
_LEFT, _WORD_END, _PHONE_END = re.compile(r"[^\w+(]+"), re.compile(r".*\w", re.S), re.compile(r".*[\w)]", re.S)
_EMAIL = re.compile(r"[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)+(?:com|org|net|edu|gov|mil|int|info|io|de|fr|es|uk|eu|us|ca|co)")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_CARD = re.compile(r"\d{13,19}")
_PHONE = re.compile(r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}")
_PHONE_PART = re.compile(r"[-().\d]*\d[-().\d]*")
_HEX = re.compile(r"(?=[^a-f]*[a-f])[0-9a-f]{16,}")
_PLAIN_PHONE = re.compile(r"\d{3}([-.])\d{3}\1\d{4}")
_GROUPS = re.compile(r"(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])")
#: What lies between signs that join several values in one token.
_PIECE = re.compile(r"""[^,;=:"'<>\[\](){}]+""")
_SECRET_WORDS = frozenset(("token", "secret", "password", "passwd", "key", "apikey", "api_key", "auth"))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def judge(value: str, left: str, left2: str) -> tuple[str | None, bool]:
    """The kind that a validator is sure of, or that one of them refutes it."""
    if _EMAIL.fullmatch(value):
        return "email", False
    if _IP.fullmatch(value):
        return ("ip", False) if all(int(x) < 256 for x in value.split(".")) else (None, True)
    if _CARD.fullmatch(value):
        return ("card", False) if _luhn(value) else (None, True)
    if _GROUPS.fullmatch(value):
        return ("card", False) if _luhn(re.sub("[ -]", "", value)) else (None, True)
    if _PHONE.fullmatch(value) or _PLAIN_PHONE.fullmatch(value):
        return "phone", False
    if len(value) >= 32 and _HEX.fullmatch(value) and (left in _SECRET_WORDS or left2 in _SECRET_WORDS and left in "=:"):
        return "secret", False
    return None, False


def shape(value: str) -> str:
    """Letters as one a, digits as 9 with the length of their run, long hexadecimals as x with theirs."""
    if _HEX.fullmatch(value):
        return f"x{len(value)}"
    return re.sub(r"\d+", lambda m: f"9:{len(m[0])} ", re.sub(r"[^\W\d_]+", "a", value))


def coarse(value: str) -> str:
    """The shape without the lengths, unless there is nothing but one run."""
    fine = shape(value)
    return fine if fine.count("9") < 2 else re.sub(r"9:\d+ ", "9", fine)


def _trim(token: str) -> tuple[int, str]:
    start = _LEFT.match(token)
    begin = start.end() if start else 0
    end = _WORD_END.match(token, begin)
    return begin, end[0] if end else ""


def _token(text: str, at: int, done: int) -> tuple[int, int]:
    """Bounds of the token around ``at``, from ``done`` on."""
    begin = max(text.rfind(" ", done, at) + 1, done)
    for blank in _BLANK.finditer(text, begin, at):
        begin = blank.end()
    end = _BLANK.search(text, at)
    return begin, end.start() if end else len(text)


def _next(text: str, end: int) -> tuple[int, int]:
    """Bounds of the token after the blank at ``end``; empty at the end of a line or the text."""
    if end + 1 >= len(text) or text[end] != " ":
        return end, end
    stop = _BLANK.search(text, end + 1)
    return end + 1, stop.start() if stop else len(text)


def _context(text: str, begin: int) -> tuple[str, str]:
    """The last and the last but one word before ``begin``, in lower case."""
    width = 64
    while True:
        words = text[max(0, begin - width) : begin].split()
        if len(words) > 2 or width >= begin:  # the first can be cut
            break
        width *= 4
    found = [_trim(word)[1] or word[:1] for word in map(str.lower, words[:-3:-1])]
    return (*found, "", "")[:2]


def _number_end(text: str, end: int) -> int:
    """``end`` moved back over signs that aren't part of a number."""
    while not text[end - 1].isalnum():
        end -= 1
    return end


def _patterns(value: str, left: str, left2: str, right: str) -> list[str]:
    fine, like = shape(value), coarse(value)
    found = [f"shape {fine}", f"left {left}|{like}", f"right {like}|{right}", f"left2 {left2} {left}|{like}"]
    if like != fine:
        found.append(f"coarse {like}")
    if left2 and left and right:
        found.append(f"around {left2} {left}|{right}")
    return [p if len(p) <= PATTERN_LENGTH else f"# {blake2b(p.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}" for p in found]


def _pieces(text: str, begin: int, start: int, end: int, pieces: list[re.Match[str]]) -> Iterator[tuple[int, int, str, str | None, bool, list[str]]]:
    """The mentions in a token of several pieces; a piece's neighbours are its context before the token's are."""
    left, left2 = _context(text, begin)
    lo, hi = _next(text, end)
    after = _trim(text[lo:hi].lower())[1]
    cut = [(start + p.start() + skip, value.lower()) for p in pieces for skip, value in [_trim(p[0])]]
    for i, (place, value) in enumerate(cut):
        if _ANCHOR.search(value):
            kind, refuted = judge(value, left, left2)
            yield place, place + len(value), value, kind, refuted, _patterns(value, left, left2, cut[i + 1][1] if i + 1 < len(cut) else after)
        if value:
            left, left2 = value, left


def mentions(text: str) -> Iterator[tuple[int, int, str, str | None, bool, list[str]]]:
    """(begin, end, instance, kind if seeded, refuted, patterns) of each token with a digit or an @; in one pass."""
    done = 0
    while anchor := _ANCHOR.search(text, done):
        begin, end = _token(text, anchor.start(), done)
        skip, value = _trim(text[begin:end])
        start, done = begin + skip, end
        groups = _GROUPS.match(text, start) if text[start + 4 : start + 5] == " " else None
        if groups and _luhn(groups[0].replace(" ", "")):
            left, left2 = _context(text, begin)
            done = groups.end()
            yield start, done, groups[0], "card", False, _patterns(groups[0], left, left2, "")
            continue
        if value[:1] not in ("+", "(") and len(pieces := list(_PIECE.finditer(value))) > 1:
            yield from _pieces(text, begin, start, end, pieces)
            continue
        parts = [value]
        if value[:1] == "+" or value[:1] == "(":
            while len(parts) < 5:
                lo, hi = _next(text, done)
                piece = _PHONE_END.match(text[lo:hi])
                if not piece or not _PHONE_PART.fullmatch(piece[0]):
                    break
                parts.append(piece[0])
                done = hi
        if not parts[0]:
            continue
        stop = start + len(value) if len(parts) == 1 else _number_end(text, done)
        value = " ".join(parts)
        if len(parts) == 1 and value[0] == "(":
            start, value = start + 1, value[1:]
        value = value.lower()
        if not value or not _ANCHOR.search(value):
            continue
        left, left2 = _context(text, begin)
        lo, hi = _next(text, done)
        right = _trim(text[lo:hi].lower())[1]
        kind, refuted = judge(value, left, left2)
        yield start, stop, value, kind, refuted, _patterns(value, left, left2, right)


MENTIONS = "begin int, end int, instance string, seed string, refuted boolean, patterns array<string>"


def _mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())]
        def out(ids: pa.Array, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int32())), *arrays], names=["doc_id", "begin", "end", "instance", "seed", "refuted", "patterns"])

        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part, rows, found = batch.slice(lo, hi - lo), [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    for m in mentions(text):
                        rows.append(i)
                        found.append(m)
                        if len(found) >= HELD:
                            yield out(part.column(0), rows, found)
                            rows, found = [], []
                if found:
                    yield out(part.column(0), rows, found)

    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    return some.mapInArrow(run, f"doc_id {kind}, {MENTIONS}")


def bootstrap(found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(instance, kind, score) of the instances known at last; ``found`` has instance, seed, refuted and patterns."""
    state = keep(found.groupBy("instance").agg(F.max("seed").alias("seed"), F.max("refuted").alias("refuted")), "instances")
    edges = found.select("instance", F.explode("patterns").alias("pattern")).distinct()
    # A pattern of fewer instances than the support can't count in any round.
    enough = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= support)
    edges = keep(edges.join(enough, "pattern"), "edges")
    known = [state.filter("seed IS NOT NULL").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))]
    unseen = state.filter("seed IS NULL AND NOT refuted").select("instance")
    sums = [F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in KINDS]
    counts = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in KINDS]
    names = [*KINDS, *(f"n_{k}" for k in KINDS)]
    masses = None
    while True:
        more = edges.join(known[-1], "instance").groupBy("pattern", "n").agg(*sums, *counts)
        if masses is not None:
            more = masses.unionByName(more).groupBy("pattern", "n").agg(*[F.sum(c).alias(c) for c in names])
        old, masses = masses, keep(more, "patterns")
        best = F.greatest(*[F.struct(F.col(k).alias("mass"), F.col(f"n_{k}").alias("n"), F.lit(k).alias("kind")) for k in KINDS])
        good = masses.select("pattern", "n", best.alias("best")).filter((F.col("best.n") >= support) & (F.col("best.mass") / F.col("n") >= confidence))
        good = good.select("pattern", F.col("best.kind").alias("kind"), (F.col("best.mass") / F.col("n")).alias("confidence"))
        fits = edges.join(good, "pattern").join(unseen, "instance", "left_semi")
        new = fits.groupBy("instance").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("instance", "best.kind", F.col("best.confidence").alias("score"))
        new = keep(new, "known")
        if old is not None:
            drop_kept(old)
        if new.isEmpty():
            drop_kept(new)
            drop_kept(masses)
            break
        known.append(new)
        unseen = keep(unseen.join(new, "instance", "left_anti"), "unseen")
    drop_kept(edges)
    return reduce(DataFrame.unionByName, known)


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, kind, value, begin, end, score): every place of an identifier, a row for each row and place.

    ``begin`` and ``end`` count characters from 0; ``value`` is in lower case, its parts joined by single blanks; the
    score is 1 for what a validator is sure of, else its best pattern's confidence when it was found. Null and empty texts have none;
    texts of any length are read whole, in time that grows with their length; repeated rows repeat their places; null doc_ids are carried; an empty table
    gives no rows. Patterns of equal confidence give the kind that is last in the alphabet. Other columns aren't read.
    """
    found = keep(_mentions(docs, id_col, text_col), "mentions")
    known = bootstrap(found, support, confidence)
    return found.select("doc_id", "instance", "begin", "end").join(known, "instance").select("doc_id", "kind", F.col("instance").alias("value"), "begin", "end", "score")

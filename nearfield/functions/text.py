"""Text columns: tokens, stop words, templates, chunks and a hashing embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of the index and of queries.
STOP_WORDS = tuple(
    "a an and are as at be by for from has he in is it its of on that the to was were will with this but they have had what when where who which or not".split()
)
SEPARATORS = r"[^\p{L}\p{Nd}]+"


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case runs of letters and digits of two bytes or more, without stop words; repeats are kept, null gives none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: F.octet_length(w) >= 2)
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def join_fields(*fields: Column) -> Column:
    """The non-empty ones with single blanks between."""
    return F.concat_ws(" ", *[F.when(f != "", f) for f in fields])


def fill_template(template: str, fields: dict[str, Column]) -> Column:
    """``{name}`` replaced by the field's text, other placeholders removed, ends trimmed; null fields count as empty."""
    parts = []
    for piece in re.split(r"(\{[^}]*\})", template):
        if piece[:1] == "{":
            if piece[1:-1] in fields:
                parts.append(F.coalesce(fields[piece[1:-1]].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.trim(F.concat(*parts)) if parts else F.lit("")


def n_tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The number of ``tokens``; 0 for null."""
    return F.size(tokens(text, stop_words))


def occurrences(lowered: Column, term: str) -> Column:
    """How often ``term`` is among the ``tokens`` of a text, both in lower case; 0 for null. Texts without it are told by a plain search."""
    pattern = rf"(?<![\p{{L}}\p{{Nd}}]){re.escape(term)}(?![\p{{L}}\p{{Nd}}])"
    return F.when(lowered.contains(term), F.regexp_count(lowered, F.lit(pattern))).otherwise(F.lit(0))


def _step(size: int, overlap: int) -> int:
    return size - (size // 4 if overlap >= size else overlap)


def n_chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """The number of ``chunks``, from the length alone."""
    return F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(float(_step(size, overlap))))).cast("int") + 1


def chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Array of chunks of ``size`` characters, each ``overlap`` into the one before, ends trimmed; the last reaches the end.

    An overlap of the size or more counts as a quarter of the size. A text that fits is one chunk; null gives null. The
    text is cut in steps in one pass, and a chunk put together from those it spans, so that a long text isn't searched
    from its beginning for each.
    """
    step = _step(size, overlap)
    steps = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))
    spans = -(-size // step)

    def cut(parts: Column, i: Column) -> Column:
        return F.trim(F.substring(F.concat(*[F.coalesce(F.get(parts, i + j), F.lit("")) for j in range(spans)]), 1, size))

    # The steps are named once, as the only element of an array, or each chunk would cut the text again.
    made = F.flatten(F.transform(F.array(steps), lambda parts: F.transform(F.sequence(F.lit(0), n_chunks(text, size, overlap) - 1), lambda i: cut(parts, i))))
    return F.when(text.isNotNull(), made)


def hashed_embedding(text: Column, dims: int = 64, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """A deterministic embedding without a model: words hashed to a dimension and a sign, counted, scaled to length 1.

    A text without words, and null, gives the zero vector. Words are cut in the JVM and counted in Arrow batches, a slice
    of a batch at a time.
    """

    @F.arrow_udf("array<double>")
    def count(words: pa.Array) -> pa.Array:
        slot_of, out = HashedWords(2 * dims), [np.zeros((0, dims))]
        for part in word_slices(words):
            row, slot = slot_of.of_rows(part)
            counts = np.bincount(row * 2 * dims + slot, minlength=len(part) * 2 * dims).reshape(len(part), 2 * dims).astype(float)
            vectors = counts[:, :dims] - counts[:, dims:]
            lengths = np.sqrt((vectors * vectors).sum(1))[:, None]
            out.append(np.divide(vectors, lengths, out=vectors, where=lengths > 0))
        matrix = np.concatenate(out)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * dims, pa.int32()), pa.array(matrix.ravel()))

    return count(tokens(text, stop_words))


#: Words and rows of a slice of an Arrow batch, and words whose hash is known, at most.
WORDS, ROWS, KNOWN = 1 << 17, 1 << 11, 1 << 16


def word_slices(words: pa.Array) -> Iterator[pa.Array]:
    """Lists of words in slices of ``WORDS`` words and ``ROWS`` rows at most, one longer list being a slice of its own, so that work on a batch takes a slice's memory."""
    ends = np.cumsum(pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(words):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS, "right"))
        hi = max(lo + 1, min(hi, lo + ROWS))
        yield words.slice(lo, hi - lo)
        lo = hi


class HashedWords:
    """Numbers below ``n`` of words, by the first four bytes of their MD5; those of some words are kept."""

    def __init__(self, n: int):
        self.n = n
        self.known: dict[str, int] = {}

    def _number(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            found = self.known[word] = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % self.n
        return found

    def of_rows(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of every word of lists of words."""
        coded = words.flatten().dictionary_encode()
        numbers = np.array([self._number(w) for w in coded.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(len(words)), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False))
        return row, numbers[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)

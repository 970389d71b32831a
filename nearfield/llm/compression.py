"""Operator 8: scoring by compression cross-entropy.

Words are counted over all documents, and over those labelled as good (the domain). The words whose repetition saves
most bytes make two raw-content zstandard dictionaries, the dearest last, where matches are cheapest; each holds what
saves nine tenths of all bytes that repetition could save, so it grows with the texts. A text's compressed size under
a dictionary stands for its cross-entropy; the score is how much smaller it is under the domain's dictionary than under
the general one, as a share of the latter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import keep, slices

#: Least room for words; a larger corpus has larger dictionaries.
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Characters of the longest word; longer ones, as of scripts without blanks, count as pieces of so many.
WORD, PIECE = 64, 16
#: Bytes that are compressed at once: a longer text is cut, so that the dictionary serves all parts of it.
BLOCK = 512 << 10
#: Distinct words that a task counts before it passes them on; bounds memory, not the result.
HELD = 1 << 19
#: The share of the bytes that all repeated words could save that those of a dictionary save, and the bins of an octave in which that is looked for.
SHARE, BINS = 0.9, 64


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; words are cut at white space, those of over ``WORD`` characters in pieces too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(np.fromiter(held.values(), np.int64, len(held)))], names=["word", "n"])

        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                for text in batch.column(0).slice(lo, hi - lo).to_pylist():
                    if text:
                        words = text.split()
                        if len(text) > WORD and max(map(len, words), default=0) > WORD:
                            words = [p for w in words for p in ([w] if len(w) <= WORD else [w[i : i + PIECE] for i in range(0, len(w), PIECE)])]
                        held.update(words)
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select(text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(counts: DataFrame, size: int = DICTIONARY_BYTES, share: float = SHARE) -> bytes:
    """The words that save most bytes, ``(n - 1)`` times their length, dearest last; ties by word.

    As many as ``size`` has room for, or as save ``share`` of all bytes that can be saved, whichever is more; so it grows
    with the counted texts.
    """
    worth = (F.col("n") - 1) * F.octet_length("word")
    # Bins of equal ratio, all of a bin or none: the driver gets a row for each to find the share.
    rows = counts.filter("n > 1").filter(F.octet_length("word") >= 2).withColumn("worth", worth).withColumn("bin", F.floor(F.log2("worth") * BINS).cast("int"))
    bins = rows.groupBy("bin").agg(F.sum("worth").alias("worth"), F.sum(F.octet_length("word") + 1).alias("bytes")).orderBy(F.col("bin").desc()).collect()
    total, saved, held, least = sum(r["worth"] for r in bins), 0, 0, 0
    for r in bins:
        if saved >= share * total and held > size:
            break
        saved, held, least = saved + r["worth"], held + r["bytes"], r["bin"]
        # What the share needs sets the size; bins beyond it are only read to fill the least size.
        if saved - r["worth"] < share * total:
            size = max(size, held)
    words = rows.filter(F.col("bin") >= least).orderBy(F.col("worth").desc(), "word").select("word").toArrow()["word"]
    out, used = [], 0
    for chunk in words.chunks:
        for at in range(0, len(chunk), 1 << 16):
            for value in chunk.slice(at, 1 << 16).to_pylist():
                word = value.encode("utf-8", "replace") + b" "
                if used + len(word) > size:
                    return b"".join(reversed(out))
                out.append(word)
                used += len(word)
    return b"".join(reversed(out))


def compressed_size(text: bytes, compressor: zstandard.ZstdCompressor) -> int:
    return sum(len(compressor.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK))


def compressor(content: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    """A compressor under a raw-content dictionary; plain if that is too short to be one."""
    options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if len(content) < 8:
        return zstandard.ZstdCompressor(level=level, **options)
    prefix = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    if len(content) <= DICTIONARY_BYTES:
        prefix.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=prefix, **options)
    # The level's own tables are too small for a larger dictionary: later words would push out earlier ones.
    log = len(content).bit_length()
    tables = max(17, min(log - 2, 24))
    params = zstandard.ZstdCompressionParameters.from_level(level, window_log=max(21, min(log + 1, 27)), hash_log=tables, chain_log=tables, **options)
    prefix.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=prefix, compression_params=params)


def score(docs: DataFrame, domain: bytes, general: bytes, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = compressor(domain, level), compressor(general, level)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                a, b = [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    a.append(None if text is None else compressed_size(text, near) if text else 0)
                    b.append(None if text is None else compressed_size(text, far) if text else 0)
                scores = [None if x is None else (y - x) / y if y else 0.0 for x, y in zip(a, b, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(scores, pa.float64())], names=["doc_id", "domain_bytes", "general_bytes", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, domain_bytes int, general_bytes int, score double")


def compression_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = DICTIONARY_BYTES) -> DataFrame:
    """(doc_id, domain_bytes, general_bytes, score), a row for each row; a higher score is nearer to the domain.

    The domain is all documents labelled with quality 1 and not toxic; without any, its dictionary is empty. A null
    text has nulls, an empty one 0, 0 and score 0. Texts of any length are compressed whole, in blocks of ``BLOCK`` bytes
    each under the dictionary. Repeated rows count and
    are scored each; a document labelled twice counts once; null doc_ids have no label; an empty table gives no rows.
    Other columns aren't read.
    """
    # The labels grow with the documents, so they are never broadcast; as a hash table they need no sort of the texts.
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("good_id")).hint("shuffle_hash")
    inside = docs.join(good, docs[id_col] == F.col("good_id"), "left_semi")
    counts = [keep(word_counts(d, id_col, text_col), name) for d, name in ((inside, "domain-words"), (docs, "words"))]
    return score(docs, *[dictionary(c, size) for c in counts], id_col, text_col)

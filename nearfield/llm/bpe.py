"""Operator 1: byte-level BPE as a lazily determinised transducer, and streaming decode.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly when every adjacent pair is the encoding of the
pair's bytes, so encodings are the paths of a nondeterministic transducer whose states are (last token, place in the
vocabulary trie of the next one). ``Transducer`` determinises it on demand: a state is the set of live hypotheses, each
with the tokens it would emit beyond what all of them share; the shared ones are emitted at once. A token is at most
``max_token`` bytes, so a hypothesis lives at most that long and tokens leave after bounded lookahead. Transitions are
made when first taken and kept in a table of bounded size, emptied when full.

Decoding. ``Utf8Machine`` is the DFA of UTF-8 over the bytes of an unfinished character; ``StreamDecoder`` takes tokens
one after another and lifts the machine's steps from bytes to whole tokens, again made when first taken.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from nearfield.llm.common import slices

#: Rank file of the vocabulary: lines of base64 token and rank.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How text is cut before merges: contractions, then runs of letters, digits, other signs (each with one space before), white space.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries after which a table of made transitions is emptied.
MAX_TRANSITIONS = 400_000
MAX_WORDS = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: not byte-level, some single bytes are no tokens")
    return ranks


def merge(ranks: dict[bytes, int], data: bytes, below: int | None = None) -> list[bytes]:
    """The merges by definition: join the adjacent pair of lowest rank (under ``below``), leftmost first, until none is left."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best) and (below is None or rank < below):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """The transducer of one vocabulary; ``encode(word)`` runs it over a piece's bytes."""

    def __init__(self, ranks: dict[bytes, int], max_transitions: int = MAX_TRANSITIONS):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.max_transitions = max_transitions
        self.max_token = max(map(len, ranks))
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                at = self.child.get(key)
                if at is None:
                    at = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = at
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self.spines: dict[tuple[int, bool], tuple[tuple[bytes, int], ...]] = {}
        self.endless = len(ranks) + max(ranks.values()) + 1
        self.reset()

    def reset(self) -> None:
        #: (state, byte): next state, and above bit 32 what is emitted.
        self.table: dict[int, int] = {}
        self.outputs: list[tuple[int, ...]] = [()]
        self.output_number: dict[tuple[int, ...], int] = {(): 0}
        #: state: (last token emitted or -1, ((trie node, tokens pending before it), ...)), the last hypothesis being at a boundary.
        self.states: list[tuple[int, tuple[tuple[int, tuple[int, ...]], ...]]] = []
        self.number: dict[tuple, int] = {}
        self._state((-1, ((0, ()),)))

    def _state(self, state: tuple) -> int:
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
        return at

    def spine(self, token: int, right: bool) -> tuple[tuple[bytes, int], ...]:
        """The parts on the token's right (or left) edge, outermost first, each with the rank of the merge that takes it in."""
        known = self.spines.get((token, right))
        if known is None:
            data, rank, out = self.bytes_of[token], self.endless, []
            while True:
                out.append((data, rank))
                if len(data) == 1:
                    break
                rank = self.ranks[data]
                parts = merge(self.ranks, data, rank)
                if len(parts) != 2:
                    raise ValueError("a token of the vocabulary isn't its own encoding")
                data = parts[1] if right else parts[0]
            known = self.spines[token, right] = tuple(out)
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether (left, right) is the encoding of its own bytes: no merge across the border comes before those within."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.max_transitions:
                self.pairs.clear()
            ranks, rights, known = self.ranks, self.spine(right, False), True
            for a, until_a in self.spine(left, True):
                for b, until_b in rights:
                    rank = ranks.get(a + b)
                    # Of two merges of the same rank the one further left comes first.
                    if rank is not None and rank < until_a and rank <= until_b:
                        known = False
            self.pairs[key] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        last, live = self.states[state]
        child, token_at, inner = self.child, self.token_at, self.inner
        moved: list[tuple[int, tuple[int, ...]]] = []
        ended: tuple[int, ...] | None = None
        for node, pending in live:
            at = child.get(node << 8 | byte)
            if at is None:
                continue
            if ended is None and (token := token_at[at]) >= 0:
                before = pending[-1] if pending else last
                if before < 0 or self.compatible(before, token):
                    ended = (*pending, token)
            if inner[at]:
                moved.append((at, pending))
        if ended is None:
            raise ValueError("the vocabulary's merges aren't locally checkable")
        moved.append((0, ended))
        shared = ended
        for _, pending in moved:
            n = 0
            while n < len(shared) and n < len(pending) and shared[n] == pending[n]:
                n += 1
            shared = shared[:n]
        n = len(shared)
        if n:
            last = shared[-1]
            moved = [(node, pending[n:]) for node, pending in moved]
        out = self.output_number.get(shared)
        if out is None:
            out = self.output_number[shared] = len(self.outputs)
            self.outputs.append(shared)
        return out << 32 | self._state((last, tuple(moved)))

    def encode(self, data: bytes) -> tuple[int, ...]:
        table, outputs, state, out = self.table, self.outputs, 0, []
        for byte in data:
            key = state << 8 | byte
            step = table.get(key)
            if step is None:
                if len(table) >= self.max_transitions:
                    here = self.states[state]
                    self.reset()
                    table, outputs, state = self.table, self.outputs, self._state(here)
                    key = state << 8 | byte
                step = table[key] = self._step(state, byte)
            state = step & 0xFFFFFFFF
            if step > 0xFFFFFFFF:
                out += outputs[step >> 32]
        out.extend(self.states[state][1][-1][1])
        return tuple(out)


class _Words(dict):
    """The transducer's results for whole pieces, as packed int32: the commonest pieces occur again and again.

    Bounded: when ``limit`` pieces are held they become the old generation, of which those in use are taken over again.
    """

    def __init__(self, transducer: Transducer, limit: int = MAX_WORDS):
        super().__init__()
        self.transducer, self.limit, self.old = transducer, limit, {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = array("i", self.transducer.encode(word.encode("utf-8", "surrogatepass"))).tobytes()
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class Utf8Machine:
    """UTF-8 as a DFA: a state is the well-formed start of an unfinished character, at most three bytes."""

    @staticmethod
    def step(pending: bytes, byte: int) -> tuple[str, bytes]:
        """Text that ``byte`` completes and the next state; ill-formed parts become U+FFFD, one for each maximal part."""
        if not pending:
            if byte < 0x80:
                return chr(byte), b""
            if 0xC2 <= byte <= 0xF4:
                return "", bytes([byte])
            return "\ufffd", b""
        first = pending[0]
        low, high = 0x80, 0xBF
        if len(pending) == 1:
            low = {0xE0: 0xA0, 0xF0: 0x90}.get(first, low)
            high = {0xED: 0x9F, 0xF4: 0x8F}.get(first, high)
        if not low <= byte <= high:
            text, state = Utf8Machine.step(b"", byte)
            return "\ufffd" + text, state
        size = 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        done = pending + bytes([byte])
        if len(done) < size:
            return "", done
        code = first & (0x7F >> size)
        for b in done[1:]:
            code = code << 6 | b & 0x3F
        return chr(code), b""


class StreamDecoder:
    """Decodes tokens as they come: ``feed`` returns the text that is certain by now, ``finish`` the rest."""

    def __init__(self, bytes_of: dict[int, bytes], lifted: dict | None = None):
        self.bytes_of, self.state = bytes_of, b""
        self.lifted: dict[tuple[bytes, int], tuple[str, bytes]] = {} if lifted is None else lifted

    def feed(self, tokens: Iterable[int]) -> str:
        out, state, lifted = [], self.state, self.lifted
        for token in tokens:
            step = lifted.get((state, token))
            if step is None:
                text, at = "", state
                for byte in self.bytes_of[token]:
                    piece, at = Utf8Machine.step(at, byte)
                    text += piece
                if len(lifted) >= MAX_TRANSITIONS:
                    lifted.clear()
                step = lifted[state, token] = text, at
            out.append(step[0])
            state = step[1]
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        left, self.state = self.state, b""
        return "\ufffd" if left else ""


class Codec:
    """Both directions for one vocabulary; kept by each worker process."""

    def __init__(self, path: str, transitions: int = MAX_TRANSITIONS, words: int = MAX_WORDS):
        ranks = load_ranks(path)
        self.transducer = Transducer(ranks, transitions)
        self.words = _Words(self.transducer, words)
        self.find = regex.compile(SPLIT).findall
        self.bytes_of = self.transducer.bytes_of
        self.lifted: dict = {}
        #: By token: its text if it is whole characters.
        self.whole = np.full(max(self.bytes_of) + 1, None, object)
        for token, data in self.bytes_of.items():
            text, state = [], b""
            for byte in data:
                piece, state = Utf8Machine.step(state, byte)
                text.append(piece)
            if not state and "\ufffd" not in (joined := "".join(text)):
                self.whole[token] = joined

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.words.__getitem__, self.find(text))), np.int32)

    def decode(self, tokens: np.ndarray) -> str:
        try:  # every token begins and ends in the machine's start state
            return "".join(self.whole[tokens].tolist())
        except TypeError:
            decoder = StreamDecoder(self.bytes_of, self.lifted)
            return decoder.feed(tokens.tolist()) + decoder.finish()


@lru_cache(maxsize=2)
def codec(path: str, transitions: int = MAX_TRANSITIONS, words: int = MAX_WORDS) -> Codec:
    return Codec(path, transitions, words)


def _ship(spark: SparkSession, vocabulary: str) -> str:
    """Send the vocabulary to all executors; the name under which they find it."""
    spark.sparkContext.addFile(vocabulary)
    return vocabulary.rpartition("/")[2]


def encode_documents(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", transitions: int = MAX_TRANSITIONS, words: int = MAX_WORDS) -> DataFrame:
    """Encode whole texts and decode them again: (doc_id, n_tokens, token_ids, round_trip), one row for each row.

    A null text has null n_tokens, token_ids and round_trip; an empty one 0, [] and true. Texts of any length are
    encoded whole. The vocabulary is a file that the driver can read; it is shipped to the executors. Rows with a null or repeated doc_id are kept as they are; other columns aren't read. No shuffle.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("round_trip", T.BooleanType()),
    ])

    shipped = _ship(docs.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(SparkFiles.get(shipped), transitions, words)
        kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, hi in slices(texts):
                counts, same, flat = [], [], []
                for text in texts.slice(lo, hi - lo).to_pylist():
                    if text is None:
                        counts.append(-1)
                        same.append(None)
                        continue
                    tokens = both.encode(text)
                    same.append(both.decode(tokens) == text)
                    counts.append(len(tokens))
                    flat.append(tokens)
                n = np.array(counts, np.int32)
                offsets = np.concatenate([[0], np.cumsum(np.maximum(n, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)), type=kind, mask=pa.array(n < 0))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n, mask=n < 0), lists, pa.array(same, pa.bool_())], names=schema.names)

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)


def decode_tokens(tokens: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", tokens_col: str = "token_ids") -> DataFrame:
    """Decode arrays of tokens: (doc_id, text). Null arrays give null, empty ones ''; ill-formed UTF-8 gives U+FFFD; a null or unknown token is an error."""
    schema = T.StructType([T.StructField("doc_id", tokens.schema[id_col].dataType), T.StructField("text", T.StringType())])

    shipped = _ship(tokens.sparkSession, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(SparkFiles.get(shipped))
        for batch in batches:
            texts = [None if t is None else both.decode(np.array(t, np.int32)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return tokens.select(tokens[id_col], tokens[tokens_col]).mapInArrow(run, schema)

import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import bpe

PATH = bpe.DEFAULT_VOCABULARY


@pytest.fixture(scope="module")
def brute():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    pat = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})


SAMPLES = ["", "a", "  two  spaces\n\n", "it's", "ñandú über 北京 🙂🙂", "x" * 3000, "aaaa bbbb" * 50, "\u0000�", "12345 6789", "</p>\r\n\tend"]


@pytest.mark.parametrize("text", SAMPLES)
def test_same_as_merges(brute, text):
    codec = bpe.codec(PATH)
    assert codec.encode(text).tolist() == brute.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_random_text(text):
    codec = bpe.codec(PATH)
    ranks = codec.transducer.ranks
    for word in codec.find(text):
        data = word.encode()
        assert list(codec.transducer.encode(data)) == [ranks[t] for t in bpe.merge(ranks, data)]
    assert codec.decode(codec.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30))
def test_stream_decoder_is_replacing_decoder(data):
    codec = bpe.codec(PATH)
    ranks = codec.transducer.ranks
    decoder = bpe.StreamDecoder(codec.bytes_of)
    out = "".join(decoder.feed([ranks[bytes([b])]]) for b in data) + decoder.finish()
    assert out == data.decode("utf-8", "replace")


def test_small_tables_are_emptied_and_refilled():
    ranks = bpe.load_ranks(PATH)
    small = bpe.Transducer(ranks, max_transitions=50)
    for word in (b" tokenization", b"internationalisation", b"aaaaaaaaaaaaaaaaaaaaaaaaaa"):
        assert list(small.encode(word)) == [ranks[t] for t in bpe.merge(ranks, word)]


def test_one_long_piece_keeps_the_bound():
    ranks = bpe.load_ranks(PATH)
    small, large = bpe.Transducer(ranks, max_transitions=100), bpe.Transducer(ranks)
    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=20_000)).encode()
    assert small.encode(word) == large.encode(word) and len(small.table) <= 100 < len(large.table)


def test_documents(spark, brute):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "x"), (3, "", "y"), (None, "naïve " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    out = bpe.encode_documents(docs).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out}
    assert by[1].token_ids == brute.encode_ordinary("hello world") and by[1].round_trip
    assert by[2].n_tokens is None and by[2].token_ids is None and by[2].round_trip is None
    assert by[3].n_tokens == 0 and by[3].token_ids == [] and by[3].round_trip
    assert by[None].n_tokens == len(brute.encode_ordinary("naïve " * 5000))
    back = bpe.decode_tokens(bpe.encode_documents(docs)).collect()
    assert sorted(map(str, (r.text for r in back))) == sorted(str(t) for _, t, _ in rows)
    assert bpe.encode_documents(docs.limit(0)).count() == 0

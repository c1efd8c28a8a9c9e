"""Encoding against the tiktoken library, decoding as an exact round trip."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm.byte_bpe import decode_documents, encode_documents, load
from folioforge.llm.queries_bpe import RANKS, round_trip

PATH = public_tokenizers.path(RANKS)


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ENC = reference()
BPE = load(PATH, public_tokenizers.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text() | st.text(alphabet="aeinorst", min_size=30, max_size=300) | st.text(alphabet="a ", max_size=200) | st.text(alphabet="=-#\n\t ", max_size=200) | st.text(alphabet="日本語のшщый", max_size=120))
def test_same_ids_and_round_trip(text):
    ids = BPE.encode(text)
    assert ids == ENC.encode_ordinary(text)
    assert BPE.decode(ids).decode() == text


@pytest.mark.parametrize("piece", ["a" * 5000, "ab" * 3000, "Donaudampfschifffahrt" * 300, "=" * 4097, "é" * 2500, " " * 3000, "xyzzy" * 777 + "q"])
def test_long_pieces(piece):
    assert BPE.encode(piece) == ENC.encode_ordinary(piece)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200), st.binary(max_size=200))
def test_join_is_the_encoding_of_the_concatenation(a, b):
    assert BPE.join(BPE.merge(a) if a else [], BPE.merge(b) if b else []) == (BPE.merge(a + b) if a + b else [])


def test_every_token_is_its_own_encoding():
    assert all(BPE._merge_with_heap(t) == [r] or len(t) == 1 for t, r in BPE.ranks.items() if len(t) > 1)


def test_query(spark):
    texts = [None, "", "Hello  world\n", "<|endoftext|> é 日本", "a" * 100_000, "x", "x"]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in round_trip(docs).collect()}
    for i, t in enumerate(texts):
        ids = ENC.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert round_trip(docs.limit(0)).count() == 0
    alone = decode_documents(encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in alone.collect()} == {i: t or "" for i, t in enumerate(texts)}

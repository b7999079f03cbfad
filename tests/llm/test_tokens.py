"""Token files: exact round trips, the library's own ids, order and sums."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import tokens
from lodestar.llm.common import new_path


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.booleans(), st.integers(1, 70))
@settings(max_examples=60, deadline=None)
def test_planes_round_trip(ids, bits, block):
    x = np.array(ids, "<u4")
    chunks, payload = tokens.encode_segment(x, bits, block)
    assert (tokens.decode_segment(chunks, payload, bits) == x).all() and sum(c["ids"] for c in chunks) == len(x)


HARD = ["Hello, World. it's <|endoftext|> A<|EndOfText|> 0 10 x0y É E\u0301 Σας..,, a., \u3000 b\x1cc don't.", "", " ", "0", "a\x00b", "é. É, \u20ac.", "x" * 5000, "<|startoftext|>,"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def test_words_give_the_library_s_ids(library, spark, sf):
    texts = HARD + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = tokens.WordEncoder(tokens.tokenizer_path())(texts)
    for t, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
def test_files(spark, library, bits):
    rows = [(7, "seven words"), (3, None), (5, HARD[0]), (3, ""), (None, "null id"), (9, "x " * 3000), (5, HARD[0])]
    out = new_path(spark, "t")
    tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), out, tokens.tokenizer_path(), bits=bits)
    got = sorted((tuple(r) for r in tokens.read_tokens(spark, out, bits).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 3, 3, 5, 5, 7, 9]
    at = 0
    texts = {7: "seven words", 3: "", 5: HARD[0], None: "null id", 9: "x " * 3000}
    for d, start, n, crc in got:
        ids = [*library.encode(texts[d], add_special_tokens=False).ids, 2]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path("byte_bpe_50k.json")
    own, texts = Tokenizer.from_file(path), [*HARD, "Hello World, it is  2024", None]
    encoder = tokens.WordEncoder(path)
    assert not encoder.by_word and tokens.WordEncoder(tokens.tokenizer_path()).by_word
    for t, raw in zip(texts, encoder(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == own.encode(t or "", add_special_tokens=False).ids


def test_query_on_the_table(spark, sf, library):
    docs = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()))
    got, at = {r["doc_id"]: r for r in tokens.op5_token_ids(spark, sf).collect()}, 0
    assert len(got) == len(docs)
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(got[d])[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_table(spark):
    out = new_path(spark, "t")
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), out, tokens.tokenizer_path())
    assert tokens.read_tokens(spark, out).count() == 0

import hashlib
import zlib

import numpy as np
import pytest
from helpers import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseam.llm import bpe_chunks, encoders, queries, token_files
from tests.conftest import SF

ODD = ["", "  a  b\n\n c \t", "<|endoftext|> x", "x<|startoftext|>Y", "É'S it's IT'LL don’t 12½ ²³ \x1c a\x1fb \x85 \xa0z", "'s's a's 's", "İstanbul ſ", "日本語 text é é ́x", "AAA aA A", "ß Σας ΑΣ", "_a_b__c 1_2 a1b2", "...\n\n\n..."]


@pytest.fixture(scope="module")
def word():
    return encoders.WordEncoder.opened(queries.tokenizer_path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def byte():
    return encoders.ByteEncoder.opened(queries.tokenizer_path("byte_bpe_50k.json"))


def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + ODD


def test_encoders_agree_with_the_library(spark, word, byte):
    for text in texts(spark):
        for e in (word, byte):
            assert e.encode(text).tolist() == e.library.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.sampled_from("aAzé'stS 1½.,\n\t\x1c_<|>İ"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_encoders_agree_on_any_text(text):
    for e in (encoders.WordEncoder.opened(queries.tokenizer_path("word_bpe_49k.json")), encoders.ByteEncoder.opened(queries.tokenizer_path("byte_bpe_50k.json"))):
        assert e.encode(text).tolist() == e.library.encode(text, add_special_tokens=False).ids


def test_chunks_agree_with_whole_texts(spark, word):
    coder = bpe_chunks.ChunkedCoder(word, 64 << 20)
    for text in texts(spark) * 2:
        data = text.encode()
        for at in (bpe_chunks.cuts(np.frombuffer(data, np.uint8), 16), bpe_chunks.cuts(np.frombuffer(data, np.uint8))):
            ids, decoded = coder.code(data, at[(at >= 16) & (at < len(data))].tolist())
            want = word.library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert decoded.decode() == word.library.decode(want, skip_special_tokens=False)
    assert coder.hits > 0.9 * coder.misses


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    a, b, passage = (rng.integers(0, 256, n).astype(np.uint8) for n in (5000, 777, 20_000))
    one, two = bpe_chunks.cuts(np.concatenate([a, passage]), 256) - 5000, bpe_chunks.cuts(np.concatenate([b, passage]), 256) - 777
    assert one[one > 16].tolist() == two[two > 16].tolist() and len(one) > 40
    assert bpe_chunks.cuts(passage, 256, 1000).tolist() == bpe_chunks.cuts(passage, 256).tolist()


def test_op3_query(spark, word):
    got = {r.doc_id: r for r in queries.op3_bpe_chunks(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = word.library.encode(r.text or "", add_special_tokens=False).ids
        x = got[r.doc_id]
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(word.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op3_awkward(spark, word):
    rows = bpe_chunks.encode_chunked(awkward(spark), word).collect()
    assert len(rows) == 10 and {r.n_tokens for r in rows if r.doc_id in (1, 2, 5)} == {0}
    assert next(r.n_tokens for r in rows if r.doc_id == 6) == 30_000
    assert bpe_chunks.encode_chunked(empty(spark), word).count() == 0


@given(st.lists(st.integers(0, (1 << 17) - 1), max_size=70), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_packing(ids, bits):
    ids = np.array(ids, np.uint32) & np.uint32((1 << bits) - 1)
    assert token_files.unpack(token_files.pack(ids, bits), len(ids), bits).tolist() == ids.tolist()


def test_random_access(tmp_path):
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 5, 30_000, 8192, 1, 0, 700_000)]
    for bits in (16, 17, 19):
        w = token_files.TokenFileWriter(f"{tmp_path}/x{bits}", bits)
        for k, d in enumerate(docs):
            w.add(k if k else None, d)
        w.close()
        f = token_files.TokenFile(f"file://{tmp_path}/x{bits}")
        for k in (6, 2, 0, 5, 3):
            assert f.document(k).tolist() == docs[k].tolist()
        assert [(k, d.tolist()) for k, d in f.documents(9000)] == [(k if k else None, d.tolist()) for k, d in enumerate(docs)]


def test_op5_query(spark, byte):
    got = sorted(queries.op5_token_files(spark, SF).collect())
    start = 0
    for x, r in zip(got, spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = [*byte.library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert tuple(x) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op5_awkward(spark, byte):
    files = token_files.write_token_files(awkward(spark), token_files.token_folder(spark), byte, 2, byte.vocabulary)
    rows = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8] and rows[1].n_tokens == 1
    files = token_files.write_token_files(empty(spark), token_files.token_folder(spark), byte, 2, byte.vocabulary)
    assert token_files.read_token_files(files).count() == 0

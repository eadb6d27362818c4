"""Token store: ids equal the tokenizer's, exact round trip, short access, edge cases."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from callqc.llm import queries, token_store
from callqc.llm.common import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["the", "The", " ", "\n", "'s", "don't", "é", "É", "ß", "...", "a,", "(b)", "12", "<|endoftext|>",
                                                                 "\x85", "\xa0", "e\u0301", "İ", "Σ", "ΑΣ", "ñá!", "\x1f", "中文", "🙂", "µ", "ª", ", ", ". ", "»", "×", "é, ", "…. ", "=\u0338", "'"]), max_size=9).map("".join)))
def test_ids_equal_the_tokenizer(text):
    got, = token_store.word_encoder(PATH).encode(pa.array([text.encode("utf-8", "replace")], pa.binary()))
    assert np.frombuffer(got, "<u2").tolist() == ids_of(text.encode("utf-8", "replace").decode())


def test_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBER", 3)
    monkeypatch.setattr(token_store, "SLICE", 5)
    encoder = token_store.WordEncoder(PATH)
    texts = ["One two, two. One", None, "", "thrée, (four) THRÉE two", "five 5, six; <|ENDOFTEXT|>, <|endoftext|>. two, one"] * 3
    got = [np.frombuffer(ids, "<u2").tolist() for ids in encoder.encode(pa.array([t and t.encode() for t in texts], pa.binary()).slice(0))]
    assert got == [ids_of(t) for t in texts]


def test_files_of_other_rules_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, text = token_store.WordEncoder(path), "Two  words,\n and <|endoftext|> é"
    assert not encoder.by_word
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(pa.array([text.encode(), None], pa.binary()))] == [Tokenizer.from_file(path).encode(text).ids, []]


def test_query(spark, sf_dir, tables):
    got = queries.op10_token_store(spark, sf_dir).orderBy("doc_id").collect()
    texts = tables.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    start = 0
    assert len(got) == len(texts)
    for r, (doc, text) in zip(got, texts, strict=True):
        ids = [*ids_of(text), 2]
        assert tuple(r) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_edge_cases_and_short_access(spark, monkeypatch, block):
    monkeypatch.setattr(token_store, "BLOCK_TOKENS", block)
    rows = [(4, "same text"), (4, "same text"), (1, None), (2, ""), (9, "long word " * 60_000), (None, "no id"), (7, "Éa <|endoftext|> b")]
    rows += [(20 + k, f"some words of document {k} " * (k % 5)) for k in range(200)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    path = new_folder(spark, "test-tokens")
    token_store.write(docs, path, PATH)
    store = token_store.Store(spark, path)
    got = {}
    for r in store.digests().collect():
        got.setdefault(r.doc_id, []).append(r)
    want, start = {}, 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*ids_of(text), 2]
        want.setdefault(doc, []).append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {k: sorted(map(tuple, v)) for k, v in got.items()} == want
    some = {r.doc_id: r for r in store.documents([9, 25, 999]).collect()}
    assert some.keys() == {9, 25} and some[25].ids == [*ids_of(dict(rows)[25]), 2] and some[25].start == want[25][0][1]
    dictionary = spark.read.parquet(f"{path}/dictionary").first()
    assert {r[0] for r in store.blocks.select("dictionary_hash").distinct().collect()} == {dictionary["hash"]}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = new_folder(spark, "test-tokens")
    token_store.write(docs, path, PATH)
    assert token_store.Store(spark, path).digests().count() == 0

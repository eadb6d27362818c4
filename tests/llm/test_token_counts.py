"""Token counts: equal to the library on every text, whatever the window, chunk and table size; edge cases."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from callqc.llm import queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
PARTS = ["the", "The", " ", "  ", "\n", "\n\n", "\t", "'s", "'S", "'re", "'r", "'v", "'ve", "'l", "'ll", "'d", "'", "''", "e", "l", "don't", "é", "é", "ß", "...", "a,", "12", "٣", "½",
         "<|endoftext|>", "<|endoftext", "\x85", "\xa0", "　", " ", "\x1f", "\0", "中文", "🙂", "ǅ", "ª", "Ⅷ", "‍", "\U0010ffff", "xqzj", "internationalization"]


def count_of(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def classes():
    return token_counts.character_classes(PATH)


@pytest.fixture(scope="module")
def counter(classes):
    return token_counts.Counter(PATH, classes)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=14).map("".join)))
def test_counts_equal_the_library(counter, text):
    text = text.encode("utf-8", "replace").decode()
    assert counter.count([text.encode()]).tolist() == [count_of(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=6), st.integers(1, 9), st.integers(1, 7))
def test_windows_and_chunks_do_not_matter(counter, texts, window, chunk):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_counts, "WINDOW", window)
        patch.setattr(token_counts, "CHUNK", chunk)
        assert counter.count([t.encode() for t in texts]).tolist() == [count_of(t) for t in texts]


@pytest.mark.parametrize("states", [2, 3, 60])
def test_a_full_table_does_not_matter(classes, states):
    small = token_counts.Counter(PATH, classes, states)
    texts = ["".join(PARTS), "some words that need more states than there are", "", "xqzj" * 50]
    assert small.count([t.encode() for t in texts]).tolist() == [count_of(t) for t in texts]
    assert len(small.states) <= states


def test_the_scan_equals_a_walk(classes):
    kinds = np.random.default_rng(5).integers(0, 12, 5000).astype(np.uint8)
    state, want = token_counts.START, np.zeros(5001, bool)
    for i, kind in enumerate(kinds.tolist()):
        state, emitted = token_counts.split_step(state, kind)
        want[i] |= bool(emitted & token_counts.HERE)
        want[i - 1] |= bool(emitted & token_counts.BEFORE)
    assert (token_counts.mark_pieces(kinds) == want[:5000]).all()


def test_query(spark, sf_dir, tables):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_token_counts(spark, sf_dir).collect()}
    texts = tables.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    assert got == {d: (len(t.encode()), n := count_of(t), n > 512) for d, t in texts}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (None, None), (4, "same"), (4, "same"), (5, "long word " * 200_000), (6, "q" * 30_000), (7, " " * 30_000 + "x"), (8, "中" * 20_000)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, id string, n_tokens int")
    got = token_counts.count_tokens(docs, PATH).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, len((t or "").encode()), count_of(t))) for d, t in rows)
    assert token_counts.count_tokens(docs.limit(0), PATH).collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        token_counts.character_classes(public_tokenizers.path("word_bpe_49k.json"))

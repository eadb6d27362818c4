"""Spelling variants: dense comparison, anchors and blocks against edit distances; edge cases."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from callqc.llm import queries, spelling
from hypothesis import given, settings
from hypothesis import strategies as st


def one_edit(a, b):
    """Plain reading: some single insertion, deletion or replacement turns a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words}


def result(spark, words, ratio=5):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r.word: tuple(r)[1:] for r in spelling.group_variants(df, ratio).collect()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=12, unique=True), st.lists(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=12, unique=True))
def test_tiles_find_every_pair_once(a, b):
    count = np.zeros((len(a), len(b)), int)
    for m, beginning in itertools.product(range(1, 8), (True, False)):
        own = [w for w in a if len(w) in (m, m - 1)], [w for w in b if len(w) in (m, m - 1)]
        if all(own):
            near = spelling.near_pairs(*own, m, beginning)
            count[np.ix_([a.index(w) for w in own[0]], [b.index(w) for w in own[1]])] += near
    assert count.tolist() == [[int(one_edit(v, w)) for w in b] for v in a]


@pytest.mark.parametrize("block,cells", [(512, 1 << 20), (3, 1 << 20), (512, 40)])
def test_groups_equal_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "CELLS", cells)
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abcé"), rng.integers(1, 8))): int(rng.choice([1, 5, 6, 30, 150, 151, 800, 5000])) for _ in range(400)}
    # a hot anchor, a chain of forms, a tie, a word beyond Latin-1 and a long one
    words |= {"prefix" + c + d: 5 for c in "abcdefgh" for d in "stuvwxyz"} | {"chainx": 5, "chainy": 25, "chaizy": 125, "chazzy": 625, "tie\U0001f600xx": 7}
    words |= {"k" * 300: 9, "k" * 299 + "j": 50, "k" * 301: 50}
    assert result(spark, words) == plain(words)


def test_form_ties_and_limits(spark):
    words = {"banana": 10, "bananb": 50, "bananc": 50, "bananas": 49, "lonely": 5}
    got = result(spark, words)
    assert got["banana"] == ("bananb", "bananb", 10, 3, 50) and got["lonely"] == (None, "lonely", 5, 0, None)
    assert got["bananas"][0] is None  # 50 is not five times 49
    with pytest.raises(ValueError):
        spelling.group_variants(spark.createDataFrame([("a", 1)], "word string, n long"), 1)


def test_words_of_odd_documents(spark):
    rows = [(1, None), (2, ""), (None, "Orchard orchard"), (None, "ORCHARD"), (7, "orchard_orchardÉ×÷ Ünter straße"), (7, "orchard " * 50_000), (8, "x" * 100_000 + " short")]
    docs = spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in spelling.count_words(docs, min_length=6, min_count=1).collect()}
    assert got == {"orchard": 50_004, "orchardÉ×÷": 1, "straße": 1, "x" * 100_000: 1}
    printed = {r.word: r.n for r in spelling.count_words(docs, min_length=6, min_count=1, misprint=1).collect()}
    want = Counter()
    for doc, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").encode().lower().decode()):
            at = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode()) % len(run)
            if len(run) > 6:
                want[run[:at] + run[at + 1 :]] += 1
    assert printed == want
    assert spelling.group_variants(spelling.count_words(docs.limit(0))).collect() == []


def test_query(spark, sf_dir, tables):
    got = {r.word: tuple(r)[1:] for r in queries.op12_spelling(spark, sf_dir).collect()}
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    want = tables.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE['op12_spelling']})").fetchall()
    assert got == {r[0]: r[1:] for r in want} and sum(v[0] is not None for v in got.values()) > 10

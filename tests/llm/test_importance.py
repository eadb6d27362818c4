"""Importance resampling: composed CRCs, dictionary of any size, plain counting; edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from callqc.llm import importance, queries
from hypothesis import given, settings
from hypothesis import strategies as st

TEXTS = st.lists(st.one_of(st.none(), st.text("abAB zé1-\n.中", max_size=40)), max_size=6)


def words_of(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").encode().lower().decode())


def features_of(text, max_run=2):
    words = words_of(text)
    return [" ".join(words[i : i + k]) for k in range(1, max_run + 1) for i in range(len(words) - k + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


@given(st.lists(st.tuples(st.binary(max_size=30), st.binary(max_size=70)), min_size=1, max_size=20))
def test_crcs_compose(pairs):
    crc = [np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1)]
    got = importance.compose(crc[0], crc[1], np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b" " + b) for a, b in pairs]


def test_crc_past_long_words():
    got = importance.compose(np.array([zlib.crc32(b"a")], np.uint32), np.array([zlib.crc32(b"x" * 3_000_000)], np.uint32), np.array([3_000_000]))
    assert got.tolist() == [zlib.crc32(b"a " + b"x" * 3_000_000)]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4), st.integers(1, 40), st.integers(0, 5), st.integers(1, 4))
def test_every_feature_once_whatever_the_dictionary_holds(batches, window, size, max_run):
    own = importance.Dictionary(size)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(importance, "WINDOW", window)
        for texts in batches:
            texts = [None if t is None else t.encode() for t in texts]
            got, n_words = Counter(), Counter()
            for text, owner, found in own.buckets(texts, 9973, max_run):
                got.update(zip(owner.tolist(), found.tolist(), strict=True))
                n_words.update(text.tolist())
            want = Counter((k, bucket(f, 9973)) for k, t in enumerate(texts) for f in features_of(t and t.decode(), max_run))
            assert got == want and n_words == Counter({k: len(words_of(t and t.decode())) for k, t in enumerate(texts) if words_of(t and t.decode())})
    assert own.size <= size


def test_a_grown_dictionary():
    own = importance.Dictionary(5000)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.3, 400) % 9000).encode() for _ in range(100)]
    for _ in range(3):
        got = Counter()
        for _, owner, found in own.buckets(texts, 997, 2):
            got.update(zip(owner.tolist(), found.tolist(), strict=True))
        assert got == Counter((k, bucket(f, 997)) for k, t in enumerate(texts) for f in features_of(t.decode()))
    assert 1000 <= own.size <= 5000


def plain(docs, target, percent, min_words, buckets):
    """Rows by a plain reading, as a sorted list."""
    s, t = (Counter(bucket(f, buckets) for x in texts for f in features_of(x)) for texts in ([x for _, x in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        found = [gain[bucket(f, buckets)] for f in features_of(text)]
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(found) // len(found) if found else 0
        rows.append((doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= min_words))
    can = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = {k: r for k, r in enumerate(can[: percent * len(can) // 100], 1)}
    rest = can[len(drawn) :] + [r for r in rows if not r[4]]
    return sorted(map(repr, [(*r[:4], k) for k, r in drawn.items()] + [(*r[:4], None) for r in rest]))


def test_edge_cases_equal_a_plain_reading(spark):
    docs = [(1, None), (2, ""), (3, " .- "), (None, "no id here, twenty words or not"), (None, "no id here, twenty words or not"), (None, "another text"), (4, "same text"), (4, "same text"), (4, "Other TEXT"),
            (5, "long words " * 150_000), (6, "x" * 200_000 + " y"), *((10 + k, f"target text {k} of many" if k % 3 else f"plain words {k}") for k in range(60))]
    target = ["target text of many kinds", None, "", "Target text"]
    df = spark.createDataFrame([(*r, 1, "w") for r in docs], "doc_id long, text string, id int, weight string").repartition(7)
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance.resample(df, bench, percent=30, min_words=2, buckets=50).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(docs, target, 30, 2, 50)
    assert importance.resample(df.limit(0), bench).collect() == []
    none = importance.resample(df, bench.limit(0), percent=100, min_words=0, buckets=50).collect()
    assert sorted(r["rank"] for r in none) == list(range(1, len(docs) + 1))


def test_query(spark, sf_dir, tables):
    got = queries.op11_importance(spark, sf_dir).collect()
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    want = tables.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE['op11_importance']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want, key=lambda r: r[0])
    docs = tables.sql("SELECT doc_id, text FROM documents").fetchall()
    target = [r[0] for r in tables.sql("SELECT text FROM benchmark").fetchall()]
    assert sorted(repr(tuple(r)) for r in got) == plain(docs, target, 25, 20, 10_000)

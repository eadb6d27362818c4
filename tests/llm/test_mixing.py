"""Mixing: targets, the flow against an exhaustive one, sums of the mix, edge cases."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from callqc.llm import mixing, queries
from callqc.llm.common import word_count


def test_targets():
    assert mixing.targets([10, 10, 10], [1, 2, 3]) == [5, 10, 15]
    assert mixing.targets([1, 99], [1, 1]) == [3, 97]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]
    # two stop, the last takes what is left
    assert mixing.targets([1, 2, 97], [3, 3, 1]) == [3, 6, 91]


def test_flow_is_cheapest_among_the_largest():
    for words in product((1, 2, 3), repeat=3):
        patterns = [(words[0], [0]), (words[1], [0, 1]), (words[2], [1])]
        for quotas in ((2, 3), (5, 1), (7, 9)):
            best = None
            limits = [range(3 * w + 1) for w in words]
            for a, c in product(limits[0], limits[2]):
                for b0, b1 in product(limits[1], repeat=2):
                    if b0 + b1 <= 3 * words[1] and a + b0 <= quotas[0] and b1 + c <= quotas[1]:
                        cost = sum(k // w + 1 for w, take in zip(words, (a, b0 + b1, c), strict=True) for k in range(take))
                        best = min(best or (0, 0), (-(a + b0 + b1 + c), cost)) if best else (-(a + b0 + b1 + c), cost)
            got = mixing.flow(patterns, quotas)
            takes = [sum(f.values()) for f in got]
            cost = sum(k // w + 1 for w, take in zip(words, takes, strict=True) for k in range(take))
            assert (-sum(takes), cost) == best
            assert all(sum(f.get(k, 0) for f in got) <= quotas[k] for k in (0, 1))


def test_query(spark, sf_dir, tables):
    got = queries.op9_mixing(spark, sf_dir).collect()
    docs = {i: (s, t or "") for i, s, t in tables.sql("SELECT doc_id, source, text FROM documents").fetchall()}
    assert len(got) == len(docs)
    size, taken = {}, {}
    for r in got:
        source, text = docs[r.doc_id]
        assert r.size == len(text.encode().split()) and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        size[source], taken[source] = size.get(source, 0) + r.size, taken.get(source, 0) + r.taken
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([size[s] for s in names], [k % 3 + 1 for k in range(len(names))]), strict=True))
    for r in got:
        assert r.source_size == size[docs[r.doc_id][0]] and r.target == pytest.approx(want[docs[r.doc_id][0]])
    assert all(abs(taken[s] - want[s]) <= max(20, 0.01 * want[s]) for s in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op9_mixing(spark, sf_dir).collect()))


def test_many_ranges_of_a_hot_source(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
                                      (F.col("id") % 50 + 1).alias("n"))
    mixed, sources = mixing.mix(docs, F.array("source"), F.col("n"))
    sums = {r.s: (r.t, r.n) for r in mixed.groupBy(F.col("members")[0].alias("s")).agg(F.sum("taken").alias("t"), F.sum("size").alias("n")).collect()}
    for name, (words, target) in sources.items():
        assert sums[name][1] == words and abs(sums[name][0] - target) <= 25  # half the largest document
    assert mixed.count() == 30_000


def test_overlaps_and_edge_cases(spark):
    rows = [(1, "a b c", ["x"]), (2, "a b", ["x", "y"]), (2, "a b", ["y", "x", "x"]), (3, None, ["x"]), (4, "", ["y"]), (5, "w " * 50_000, [None]),
            (None, "a", ["y"]), (6, "a b", None), (7, "a", [])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, members array<string>, taken int")
    mixed, sources = mixing.mix(docs, F.col("members"), word_count(F.col("text")))
    got = mixed.collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    assert {r.doc: r.taken for r in got}[6] == 0 and list(sources) == ["x", "y", None]
    empty, none = mixing.mix(docs.limit(0), F.col("members"), word_count(F.col("text")))
    assert empty.count() == 0 and none == {}


def test_word_count(spark):
    texts = ["", None, " ", "a", " a", "a ", "a\tb\n\x0b\x0c\rc", "\x1fa\x85 b", "é  x", "a\xa0b"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(word_count(F.col("t"))).collect()] == [len((t or "").encode().split()) for t in texts]

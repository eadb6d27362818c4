"""SimHash near-dedup against brute force over all pairs, and its edge cases."""

import re

import numpy as np
import xxhash

from callqc.llm import queries, simhash


def reference(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints, bits=2):
    """Smallest id of each id's component, over all pairs."""
    ids = [i for i, _ in prints]
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in prints:
        for b, y in prints:
            if a < b and (x ^ y).bit_count() <= bits:
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {i: top(i) for i in ids}


def test_query_equals_brute_force(spark, sf_dir, tables):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, sf_dir).collect()}
    texts = tables.sql("SELECT doc_id, text FROM documents").fetchall()
    prints = [(i, reference(t)) for i, t in texts]
    want = components(prints)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in prints}


def test_links_connect_exactly_the_near_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:20].tolist():  # chains and stars of flipped bits
        x = b
        for _ in range(12):
            x ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 4), replace=False))
            fps.add(x)
    # one posting of over MATRIX members: all values of two bytes that are close to zero
    fps |= {(0xABCDEF << 40) | v for v in range(1 << 16) if v.bit_count() <= 2 or v % 211 == 0}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.links(frame).collect()
    parent = {f: f for f in fps}

    def top(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for r in links:
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        parent[top(a)] = top(b)
    x = np.array(fps, np.uint64)
    true = {f: f for f in fps}

    def root(f):
        while true[f] != f:
            f = true[f]
        return f

    for k, f in enumerate(fps):
        for g in x[k + 1 :][np.bitwise_count(x[k + 1 :] ^ x[k]) <= 2].tolist():
            if root(f) != root(g):
                true[root(f)] = root(g)
    groups = lambda find: {frozenset(m) for m in _by(fps, find).values()}
    assert groups(top) == groups(root)
    assert len(links) < 28 * len(fps)


def _by(items, key):
    out = {}
    for i in items:
        out.setdefault(key(i), []).append(i)
    return out


def test_edge_cases(spark):
    rows = [(5, None, "x"), (3, "", "x"), (9, " \t\n", "x"), (4, "one two", "x"), (4, "one two", "x"), (None, "one two", "x"),
            (7, "ONE  two", "y"), (8, "w " * 100_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    by = {}
    for i, f, c in got:
        by.setdefault(f, set()).add(c)
    assert len(got) == len(rows)
    assert {c for i, f, c in got if f == 0} == {3}
    assert {c for i, f, c in got if i in (4, 7, None)} == {4}
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == [3, 4, 8]
    assert kept[0].asDict().keys() == {"doc_id", "text", "component_id"}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_copies_of_a_hot_and_of_a_rare_fingerprint(spark):
    rows = [(i, "the same text again") for i in range(10, 40)] + [(i, f"words {i} of {i * 7} own {i * 13}") for i in range(100, 3100)]
    docs = spark.createDataFrame([*rows, (1, "the same text again"), (2, f"words 200 of 1400 own {200 * 13}")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    want = components([(i, reference(t)) for i, t in rows] + [(1, reference("the same text again")), (2, reference(rows[130][1]))])
    assert got == want and {got[i] for i in range(10, 40)} == {1}

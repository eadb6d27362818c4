"""Lattice hashing: the decoder, recall against brute force, counted once, edge cases."""

import numpy as np

from callqc.llm import embeddings, queries


def brute(rows, cosine=0.98):
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows
            if v and lab is not None and i is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, *_ in rows}
    for a, (i, x, p) in enumerate(good):
        for j, y, q in good[a + 1 :]:
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[i].add(j)
                links[j].add(i)
    component = {}
    for i in sorted(k for k in links if k is not None):
        stack = [i]
        while stack:
            k = stack.pop()
            if k not in component:
                component[k] = i
                stack += links[k]
    return links, component


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1.5, (3000, 8))
    c = embeddings.nearest(x)
    near = ((x - c) ** 2).sum(axis=1)
    other = ((x[:, None] - (c[:, None] + embeddings.NEIGHBOURS)) ** 2).sum(axis=2).min(axis=1)
    assert (near <= other + 1e-9).all() and near.max() <= 1 + 1e-9
    twice = 2 * c
    assert (twice == np.rint(twice)).all() and (np.ptp(twice % 2, axis=1) == 0).all() and (c.sum(axis=1) % 2 == 0).all()
    assert len(embeddings.NEIGHBOURS) == 240 and np.allclose((embeddings.NEIGHBOURS**2).sum(axis=1), 2)


def test_recall_right_at_the_threshold():
    rng = np.random.default_rng(2)
    for dims in (64, 256):
        a, b = rng.standard_normal((2, 1500, dims))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b -= (a * b).sum(axis=1)[:, None] * a
        b /= np.linalg.norm(b, axis=1)[:, None]
        b = 0.98 * a + np.sqrt(1 - 0.98**2) * b
        lattice = embeddings.Lattice(dims)
        x, y = lattice.cells(a), lattice.cells(b)
        met = np.zeros(len(a), bool)
        for t in range(embeddings.TABLES):
            met |= (x[:, t] == y[:, t, :1]).any(axis=1) | (y[:, t] == x[:, t, :1]).any(axis=1)
        assert met.mean() >= 0.97


def test_query_equals_brute_force(spark, sf_dir, tables):
    rows = tables.sql("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    links, component = brute([(i, list(v) if v is not None else None, lab) for i, v, lab in rows])
    got = {r.vec_id: r for r in queries.op7_embeddings(spark, sf_dir).collect()}
    assert got.keys() == links.keys()
    true = sum(map(len, links.values()))
    assert all(r.n_links <= len(links[i]) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * true
    assert sum(r.component_id == component[i] for i, r in got.items()) >= 0.95 * len(got)
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_hot_cells_in_parts_and_edge_cases(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(k, (centre + rng.standard_normal(16) * 0.02).tolist(), 1) for k in range(300)]
    rows += [(1000 + k, centre.tolist(), 2 + k % 2) for k in range(50)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [None] * 16, 1), (2004, [float("nan")] * 16, 1),
             (2005, [float("inf")] * 16, 1), (2006, centre.tolist(), None), (2007, centre.tolist()[:8], 2), (None, centre.tolist(), 2)]
    rows += [(3000 + k, rng.standard_normal(16).tolist(), 1) for k in range(100)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    links, component = brute(rows)
    for part in (64, 1024):  # parts of a cell, and cells in one piece
        got = embeddings.near_duplicates(frame, part=part).collect()
        assert len(got) == len(rows)
        by = {r.vec_id: r for r in got}
        assert {i: by[i].n_links for i in links} == {i: len(x) for i, x in links.items()}
        assert {i: by[i].component_id for i in component} == component
    assert by[None].component_id is None and by[None].kept is False and by[2004].kept
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0

"""Toxicity: held-out quality, the counterfactual penalty, edge cases."""

import zlib

import numpy as np

from callqc.llm import queries, toxicity


def test_query_held_out(spark, sf_dir, tables):
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, sf_dir).collect()}
    assert len(got) == tables.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = tables.sql("SELECT doc_id, toxic FROM labels WHERE toxic IS NOT NULL").fetchall()
    held = [(t, got[i]) for i, t in labels if i in got and got[i].held_out]
    clean = [r for t, r in held if t == 0]
    assert sum(r.predicted for r in clean) / len(clean) <= 0.02
    toxic = [r.score for t, r in held if t == 1]
    assert np.mean([s > r.score for s in toxic for r in clean]) >= 0.85


def _sample(rng, n=300):
    """Texts in which a group's mention goes along with toxicity, though the insult is the cause."""
    texts, toxic = [], []
    for k in range(n):
        bad = k % 2
        words = rng.choice(["tree", "house", "river", "music", "garden", "winter"], 4).tolist()
        words.append("women" if rng.random() < (0.8 if bad else 0.05) else "men")
        if bad and rng.random() < 0.8:
            words.append("grumblefool")
        texts.append(set(words))
        toxic.append(bad)
    return texts, np.array(toxic, float)


def test_counterfactual_penalty_clears_neutral_mentions():
    texts, toxic = _sample(np.random.default_rng(0))
    places = [np.unique([f for w in t for f in toxicity.features_of(w)]) for t in texts]
    swaps = [tuple(np.unique(toxicity.features_of(w)) for w in pair) for t in texts
             for pair in toxicity.counterfactuals(t, toxicity.IDENTITY_TERMS)]
    plain = toxicity.fit(places, toxic, swaps, penalty=0.0)
    paired = toxicity.fit(places, toxic, swaps)

    def score(model, words):
        own = np.unique([f for w in words for f in toxicity.features_of(w)])
        return float(model.score(np.array([model.weight[own].sum()]))[0])

    neutral, other = {"women", "garden", "music"}, {"men", "garden", "music"}
    assert score(plain, neutral) - score(plain, other) > 0.5
    assert abs(score(paired, neutral) - score(paired, other)) < 0.05
    assert score(paired, neutral) < 0.5 < score(paired, neutral | {"grumblefool"})


def test_edge_cases(spark):
    rows = [(1, "you grumblefool here", 1), (2, "a quiet garden", 0), (3, None, 1), (4, "", 0), (None, "grumblefool", 5)]
    rows += [(10 + k, f"winter music {k}" + (" grumblefool" if k % 2 else ""), 0) for k in range(40)]
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(10 + k, k % 2) for k in range(40)] + [(None, 1), (2, None), (11, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) + 1
    assert by[1] > 0.7 > by[2] and by[3] == by[4] < 0.7 and by[None] > 0.7
    assert toxicity.score(docs.limit(0), model).count() == 0
    for share, labels_ in ((0.0, labels.where("toxic = 0")), (0.0, labels.limit(0)), (1.0, labels.where("toxic = 1"))):
        only = toxicity.train(docs, labels_)
        assert {round(r.score, 6) for r in toxicity.score(docs, only).collect()} == {share}

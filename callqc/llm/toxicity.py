"""Toxicity: a linear classifier over words and word beginnings, regularised by counterfactuals.

Features are the different words of a text (lower case) and their beginnings of 3 to 6
letters, hashed.  Those that labelled texts hold clearly more often in one class are given
weights by logistic regression.  Sentences that mention a group are written again with the
mention swapped for every other group and for a neutral word, and the squared change of the
score is added to the loss (logit pairing): a mention alone cannot raise a score, so neutral
sentences about a group that the toxic texts often attack stay clean.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callqc.llm.common import as_bytes, map_texts

# Mentions of groups, by kind; the first of each kind is its neutral word.
IDENTITY_TERMS: dict[str, tuple[str, ...]] = {
    "plural": ("people", "women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "blacks",
               "whites", "asians", "latinos", "immigrants", "refugees", "gays", "lesbians", "transgenders", "disabled"),
    "person": ("person", "woman", "man", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant",
               "refugee", "lesbian"),
    "adjective": ("human", "female", "male", "islamic", "jewish", "black", "white", "asian", "african", "latino",
                  "gay", "trans", "transgender", "queer", "deaf", "blind"),
}

#: Labelled texts of each class that the classifier is fitted on, at most about so many,
#: chosen by a hash of the id; whole texts.  The only bounded sample here.
SAMPLE_DOCS = 3000
#: Places of hashed features.
PLACES = 1 << 20
#: Chi-squared of the class table from which a feature takes part (0.1 % for one degree of freedom).
CHI_SQUARED = 10.83
#: Weights of the counterfactual penalty and of the squared weights.
PENALTY, RIDGE = 10.0, 1e-4
#: Words whose weight a task remembers at once; it starts anew beyond.
REMEMBER = 400_000

WORD = re.compile(r"[^\W\d_]+")
ALL_ASCII = re.compile(rb"[a-z]+")


def words_of(text: bytes | None) -> set[str]:
    """Different words (runs of letters, lower case) of a whole text."""
    if not text:
        return set()
    if text.isascii():
        return {w.decode() for w in set(ALL_ASCII.findall(text.lower()))}
    return set(WORD.findall(text.decode("utf-8", "replace").lower()))


def features_of(word: str) -> list[int]:
    """Places of a word and its beginnings."""
    crc = zlib.crc32
    return [crc(f"{word}$".encode()) % PLACES,
            *(crc(word[:n].encode()) % PLACES for n in range(3, 7) if len(word) >= n)]


def counterfactuals(words: set[str], terms: dict[str, tuple[str, ...]]) -> Iterator[tuple[str, str]]:
    """``(mention, other)`` for every swap that the words of a text allow."""
    for kind in terms.values():
        for mention in words.intersection(kind):
            yield from ((mention, other) for other in kind if other != mention)


@dataclass
class Model:
    """``weight`` by place (0 for features that take no part), and the bias."""

    weight: np.ndarray
    bias: float

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def fit(
    places: list[np.ndarray], toxic: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]],
    penalty: float = PENALTY, ridge: float = RIDGE, steps: int = 1500,
) -> Model:
    """Weights from the different places of each text, its label, and swapped places (from, to).

    Without texts of both classes every score is the share of toxic texts (0 without texts).
    """
    n, n1 = len(toxic), int(toxic.sum())
    weight = np.zeros(PLACES, np.float64)
    if n1 in (0, n):
        return Model(weight, 500.0 if n and n1 == n else -500.0)
    rows = np.repeat(np.arange(n), [len(p) for p in places])
    cols = np.concatenate(places)
    a = np.bincount(cols, weights=toxic[rows], minlength=PLACES)
    b = np.bincount(cols, minlength=PLACES) - a
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (a * (n - n1 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n - a - b) * n1 * (n - n1))
    used = np.flatnonzero(np.nan_to_num(chi) >= CHI_SQUARED)
    place = np.full(PLACES, -1)
    place[used] = np.arange(len(used))
    own = place[cols] >= 0
    rows, cols = rows[own], place[cols[own]]
    pairs = [(k, place[f][place[f] >= 0], sign) for k, both in enumerate(swaps) for f, sign in zip(both, (-1.0, 1.0), strict=True)]
    pair_rows = np.repeat([k for k, _, _ in pairs], [len(f) for _, f, _ in pairs]).astype(int)
    pair_cols = np.concatenate([f for _, f, _ in pairs]).astype(int) if pairs else np.empty(0, int)
    pair_sign = np.repeat([s for _, _, s in pairs], [len(f) for _, f, _ in pairs])
    w, bias = np.zeros(len(used)), float(np.log(n1 / (n - n1)))
    m1, m2, rate = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0.05
    for step in range(1, steps + 1):  # Adam over the whole sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[cols], minlength=n) + bias, -500, 500)))
        error = (p - toxic) / n
        g = np.bincount(cols, weights=error[rows], minlength=len(used)) + 2 * ridge * w / n
        if len(pair_rows):
            change = np.bincount(pair_rows, weights=pair_sign * w[pair_cols], minlength=len(swaps))
            g += 2 * penalty / len(swaps) * np.bincount(pair_cols, weights=pair_sign * change[pair_rows], minlength=len(used))
        g = np.append(g, error.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weight[used] = w
    return Model(weight, float(bias))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    rows: Column | None = None, sample_docs: int = SAMPLE_DOCS, penalty: float = PENALTY,
    terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS,
) -> Model:
    """A model from the labelled texts of ``docs``; ``rows`` restricts the labels to learn from.

    Labels that are null are not used; of several labels for an id the highest counts.  About
    ``sample_docs`` texts of each class at most are used, chosen by a hash of the id, and only
    the places of their words (not the texts) reach the driver.
    """
    known = labels if rows is None else labels.where(rows)
    known = (known.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    classes = known.groupBy("toxic").agg(F.count("*").alias("n"))
    drawn = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = (known.join(F.broadcast(classes), "toxic").where(drawn < F.lit(float(sample_docs)) / F.col("n")).select("id", "toxic"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # a known bound: two classes of about sample_docs ids each
    sample = texts.join(F.broadcast(ids), "id").select("id", "toxic", "text")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in as_bytes(batch.column(2)):
                words = words_of(text)
                found = np.unique(np.fromiter((f for w in words for f in features_of(w)), np.int32))
                swaps = [f"{a}\t{b}" for a, b in counterfactuals(words, terms)]
                out.append((found.astype("<i4").tobytes(), swaps))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), pa.array([o[0] for o in out], pa.binary()),
                 pa.array([o[1] for o in out], pa.list_(pa.string()))], ["id", "toxic", "places", "swaps"])

    kind = docs.schema[id_col].dataType.simpleString()
    table = (sample.mapInArrow(places, f"id {kind}, toxic int, places binary, swaps array<string>").toArrow()
             .combine_chunks().sort_by([("id", "ascending"), ("places", "ascending")]))
    found = [np.frombuffer(x, "<i4") for x in table["places"].to_pylist()]
    swaps = [tuple(np.array(sorted(set(features_of(x))), int) for x in s.split("\t")) for own in table["swaps"].to_pylist() for s in own]
    return fit(found, np.array(table["toxic"].to_pylist(), float), swaps, penalty)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row, over whole texts.

    Null and empty texts, and texts without letters, have the score of the bias alone.
    Repeated rows keep a row each; an empty table gives an empty result; other columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        m = shared.value
        weights: dict[str, tuple[float, ...]] = {}
        used = m.weight != 0
        for ids, texts in batches:
            total = np.zeros(len(texts))
            for at, text in enumerate(texts):
                words = words_of(text)
                # remember for a word which of its features have a weight (most have none)
                if len(weights) > REMEMBER:
                    weights.clear()
                for w in words.difference(weights):
                    weights[w] = tuple(f for f in features_of(w) if used[f])
                hits = {f for w in words for f in weights[w]}
                if hits:
                    total[at] = m.weight[sorted(hits)].sum()
            yield ids, m.score(total)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], "text",
                     f"doc_id {kind}, score double", rows)

"""Importance resampling towards a target: hashed n-gram counts, log-ratio weights, seeded draw.

Features are runs of one to ``max_run`` words; a feature's bucket is the CRC-32 of its bytes
(words joined by one space) modulo the number of buckets.  No feature is ever built:

* a task keeps a dictionary of the words it has met, as an Aho-Corasick automaton over the
  words between two blanks; each word carries its CRC and length as a payload;
* scanning a text emits the payloads of its words in order.  What lies between two matches
  are words that the dictionary lacks: their payloads are made on the spot, and they join the
  dictionary until it is full, so every word counts whatever the dictionary holds;
* CRCs compose: that of ``a b`` follows from those of ``a`` and ``b`` and the length of ``b``,
  so the payloads of neighbours give the buckets of all runs.

Texts are scanned once for the counts and once for the weights; buckets are all that leaves a
task.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callqc.llm.common import arrow_schema, as_bytes, written

#: Words that a dictionary holds, and bytes of text scanned at once (longer texts in several windows).
MAX_WORDS, WINDOW = 100_000, 1 << 20
#: A-Z folded; what is neither a digit, a letter nor beyond ASCII is a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_BLANKS = re.compile(b"  +")


def _zero_bytes() -> np.ndarray:
    """Tables of the linear maps that carry a CRC past 1, 2, 4, ... 2**31 bytes: ``[power, byte of the CRC, value]``."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    places = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [one[places & 255] ^ (places >> 8)]
    while len(out) < 32:
        out.append(_moved(out[-1], _moved(out[-1], places)))
    return np.array(out)


def _moved(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


ZERO_BYTES = _zero_bytes()
_BLANK = np.uint32(zlib.crc32(b" "))


def compose(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of ``first second`` (a blank between) from both CRCs and the length of the second."""
    out = _moved(ZERO_BYTES[0], first) ^ _BLANK
    for k in range(int(length.max(initial=0)).bit_length()):
        far = ((length >> k) & 1).astype(bool)
        out[far] = _moved(ZERO_BYTES[k], out[far])
    return out ^ second


class Dictionary:
    """Words with payloads ``length << 32 | CRC``; grows with the texts scanned."""

    def __init__(self, max_words: int = MAX_WORDS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)  # whole numbers beyond 32 bits
        self.max_words, self.size = max_words, 0
        self.new: dict[bytes, int] = {}

    def _grow(self) -> None:
        if self.new and len(self.new) >= min(max(self.size // 2, 1000), self.max_words - self.size):
            for word, payload in self.new.items():
                self.automaton.add_word(f" {word.decode('latin-1')} ", payload)
            self.automaton.make_automaton()
            self.size += len(self.new)
            self.new = {}

    def payloads(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each word of a folded text (single blanks, also around it) begins, and its payload."""
        if self.size:
            hits = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
        else:
            hits = np.empty((0, 2), np.int64)
        begins, stops = hits[:, 0] - (hits[:, 1] >> 32), hits[:, 0]
        free_from = np.concatenate(([0], stops))
        free_to = np.concatenate((begins - 1, [len(text) - 1]))
        gaps = np.flatnonzero(free_to > free_from)
        at, found = [], []
        for a, b in zip(free_from[gaps].tolist(), free_to[gaps].tolist(), strict=True):
            place = a + 1
            for word in text[a + 1 : b].split(b" "):
                payload = self.new.get(word)
                if payload is None:
                    payload = len(word) << 32 | zlib.crc32(word)
                    if self.size + len(self.new) < self.max_words:
                        self.new[word] = payload
                at.append(place)
                found.append(payload)
                place += len(word) + 1
        self._grow()
        if not at:
            return begins, hits[:, 1]
        begins, payloads = np.concatenate((begins, at)), np.concatenate((hits[:, 1], found))
        order = np.argsort(begins, kind="stable")
        return begins[order], payloads[order]

    def buckets(self, texts: list[bytes | None], buckets: int, max_run: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(text of each word, text of each feature, bucket of each feature)``, window by window."""
        kept = max_run - 1  # words of the last window that runs of the next may begin with
        last = np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64)

        def window(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nonlocal last
            starts = np.cumsum([0, *(len(p) + 1 for _, p in parts)])[:-1] + 1
            begins, payloads = self.payloads(b" " + b" ".join(p for _, p in parts) + b" ")
            text = np.array([k for k, _ in parts])[np.searchsorted(starts, begins, "right") - 1]
            words = (payloads & 0xFFFFFFFF).astype(np.uint32)
            carried = len(last[0])
            owner, crc = np.concatenate((last[0], text)), np.concatenate((last[1], words))
            length = np.concatenate((last[2], payloads >> 32))
            owners, found, run = [text], [words % buckets], crc
            for k in range(1, max_run):
                run = compose(run[:-1], crc[k:], length[k:])
                fits = owner[:-k] == owner[k:]
                fits[: max(carried - k, 0)] = False  # ends before this window
                owners.append(owner[k:][fits])
                found.append(run[fits] % buckets)
            if kept:
                last = owner[-kept:], crc[-kept:], length[-kept:]
            return text, np.concatenate(owners), np.concatenate(found).astype(np.int64)

        parts: list[tuple[int, bytes]] = []
        held = 0
        for k, raw in enumerate(texts):
            text = _BLANKS.sub(b" ", (raw or b"").translate(_FOLD)).strip(b" ")
            while text:
                cut = len(text) if len(text) <= WINDOW else text.find(b" ", WINDOW)
                part, text = (text, b"") if cut < 0 else (text[:cut], text[cut + 1 :])
                parts.append((k, part))
                held += len(part)
                if held >= WINDOW:
                    yield window(parts)
                    parts, held = [], 0
        if parts:
            yield window(parts)


@lru_cache(maxsize=1)
def dictionary(max_words: int) -> Dictionary:
    """One dictionary per Python worker: the words it has met serve later tasks too."""
    return Dictionary(max_words)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = 10_000, max_run: int = 2) -> DataFrame:
    """``bucket, n``: features of all texts (null: none) by bucket; added up in the tasks first."""
    out = arrow_schema("bucket int, n long")
    max_words = MAX_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = dictionary(max_words), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in own.buckets(as_bytes(batch.column(0)), buckets, max_run):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], schema=out)

    parts = texts.select(F.col(text_col).cast("binary")).mapInArrow(run, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = 10_000, max_run: int = 2) -> list[int]:
    """Gain of every bucket: ``floor(1000 * ln(target share / documents' share))`` with one added to each
    bucket's count.  The driver gets a number per bucket and side, whatever the tables hold."""
    counts = []
    for texts, column in ((docs, text_col), (target, target_col)):
        own = [0] * buckets
        for r in bucket_counts(texts, column, buckets, max_run).collect():
            own[r.bucket] = r.n
        counts.append(own)
    (s, t), (s_all, t_all) = counts, map(sum, counts)
    return [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", max_run: int = 2) -> DataFrame:
    """``id, n_words, n_features, weight``: the floored mean gain of each row's features (none: 0)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_features long, weight long"
    out, max_words = arrow_schema(schema), MAX_WORDS
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))  # a number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gain = dictionary(max_words), shared.value
        for batch in batches:
            n = batch.num_rows
            words, features, total = (np.zeros(n, np.int64) for _ in range(3))
            for text, owner, found in own.buckets(as_bytes(batch.column(1)), len(gain), max_run):
                words += np.bincount(text, minlength=n)
                features += np.bincount(owner, minlength=n)
                np.add.at(total, owner, gain[found])
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), *(pa.array(c, pa.int64()) for c in (words, features, weight))], schema=out)

    used = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return used.mapInArrow(run, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id",
             text_col: str = "text", target_col: str = "text", buckets: int = 10_000, max_run: int = 2) -> DataFrame:
    """Every row's ``<id_col>, n_features, weight, score, rank``: ``percent`` of the rows with ``min_words``
    words or more are drawn without replacement, likelier the more they look like ``target``.

    The score adds to the weight a Gumbel value from the hash of ``<seed>:<id>``, so the draw is the
    highest scores (ties: smaller id, null first, then fewer features) and reruns agree; undrawn rows
    have no rank.  Null and empty texts weigh 0; a null id counts as an empty one; rows that repeat an
    id are drawn on their own; empty tables give no rows, or no gain; other columns are not read.
    """
    weighed = weigh(docs, gains(docs, target, text_col, target_col, buckets, max_run), id_col, text_col, max_run)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    hashed = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000) * F.log(-F.log((hashed + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = written(weighed.select("id", "n_features", "weight", (F.col("weight") + gumbel).alias("score"), (F.col("n_words") >= min_words).alias("can"),
                                    F.monotonically_increasing_id().alias("row")), "scored")
    # a row's place in the order is its place in its sorted part and the rows of the parts before: no task sees all
    order = [F.col("can").desc(), F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("n_features"), F.col("row")]
    placed = written(scored.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned("place", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row per part
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = placed.where("can").agg(F.floor(F.count(F.lit(1)) * percent / 100).alias("n")).scalar()
    ranked = placed.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", rank)
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))

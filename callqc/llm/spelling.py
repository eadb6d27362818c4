"""Spelling variants: words one edit apart, grouped under their most frequent form.

Two words are one inserted, deleted or replaced code point apart exactly when the common
prefix and the common suffix together reach the longer length minus one.  Words are laid out
as dense matrices of code points, padded at the end (prefixes) and at the beginning
(suffixes), and blocks of words are compared with each other as tiles.

Only words that can be a pair meet in a tile: if prefix and suffix together reach ``m - 1`` of
the longer length ``m``, one of the two reaches ``m // 2``, so the words share their first or
their last ``m // 2`` code points.  A word thus stands under four anchors (as the longer and as
the shorter word; beginning and end), and a pair is counted under its beginning wherever that
is shared, else under its end: once.  An anchor of many words is dealt by hash into blocks of bounded size, and
every two of its blocks are a tile of their own, so no task holds an anchor's words and no
pair is missed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.llm.common import arrow_schema, as_bytes, written

#: Words of a block, and code points of its matrix (long words make smaller blocks).
BLOCK, CELLS = 512, 1 << 20
#: Different words that a task adds up before it passes their counts on.
HELD_WORDS = 200_000
_LETTERS = "a-zÀ-ÿ"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5,
                misprint: int = 0) -> DataFrame:
    """``word, n``: maximal runs of Latin letters (A-Z folded) of at least ``min_length`` code points
    that occur ``min_count`` times in all texts.

    With ``misprint``, a run whose hash with its document's id (as text; null: empty) is a multiple
    of it loses one letter before it is counted: variants whose origin is known.
    Null and empty texts have no words; repeated rows count again; other columns are not read.
    """
    find = re.compile(f"[{_LETTERS}]{{{max(min_length, 1)},}}").findall
    out = arrow_schema("word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1)), strict=True):
                found = Counter(find((text or b"").lower().decode("utf-8", "replace")))
                if misprint:
                    first = zlib.crc32((doc or b"") + b":")
                    for word in [w for w in found if zlib.crc32(w.encode(), first) % misprint == 0]:
                        at = zlib.crc32(word.encode(), first) % len(word)
                        n = found.pop(word)
                        if len(word) > min_length:
                            held[word[:at] + word[at + 1 :]] += n
                held.update(found)
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=out)
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=out)

    used = docs.select(F.col(id_col).cast("string").cast("binary").alias("id"), F.col(text_col).cast("binary").alias("text"))
    parts = used.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _matrix(words: list[str], width: int, last: bool) -> np.ndarray:
    """Code points of the words, a row each; padded with -1 at the end, or at the beginning (``last``)."""
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    row = np.repeat(np.arange(len(words)), lengths)
    column = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((len(words), width), -1, np.int32)
    out[row, column + (np.repeat(width - lengths, lengths) if last else 0)] = points
    return np.ascontiguousarray(out.T)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading rows in which column i of ``a`` equals column j of ``b``, for every i and j (padding equals nothing)."""
    alive = np.ones((a.shape[1], b.shape[1]), bool)
    n = np.zeros(alive.shape, np.int32)
    for x, y in zip(a, b, strict=True):
        alive &= (x[:, None] == y[None, :]) & (x >= 0)[:, None]
        if not alive.any():
            break
        n += alive
    return n


def near_pairs(a: list[str], b: list[str], m: int, beginning: bool) -> np.ndarray:
    """Which words of ``a`` and ``b`` are one edit apart, the longer of ``m`` code points, and
    counted under their beginning (or end)."""
    prefix = _common(_matrix(a, m, False), _matrix(b, m, False))
    suffix = _common(_matrix(a, m, True)[::-1], _matrix(b, m, True)[::-1])
    longest = np.maximum.outer(np.array([len(w) for w in a]), np.array([len(w) for w in b])) == m
    return longest & (prefix + suffix >= m - 1) & (prefix < m) & ((prefix >= m // 2) == beginning)


def _tiles(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Compare rows ``m, beginning, anchor, one, two, blocks, block, word, n`` sorted by their tile."""
    held: dict[tuple, tuple[list[tuple[str, int]], list[tuple[str, int]]]] = {}
    size = 0
    kind: tuple | None = None

    def best(near: np.ndarray, own: list[tuple[str, int]], other: list[tuple[str, int]]) -> list[tuple]:
        order = sorted(range(len(other)), key=lambda i: (-other[i][1], other[i][0]))
        place = np.empty(len(other), np.int64)
        place[order] = np.arange(len(other))
        found = near.sum(axis=1)
        first = np.where(near, place[None, :], len(other)).min(axis=1)
        return [(own[i][0], int(found[i]), other[order[first[i]]][1], other[order[first[i]]][0]) for i in np.flatnonzero(found).tolist()]

    def compared() -> Iterator[pa.RecordBatch]:
        if kind is None or not held:
            return
        m, beginning = kind
        rows = []
        # anchors of one block each share a tile: what a pair has in common is looked at again
        alone = [[w for (_, _, _, blocks), pair in held.items() if blocks == 1 for w in pair[0]]]
        alone += [pair[0] for (_, one, two, blocks), pair in held.items() if blocks > 1 and one == two]
        for own in alone:
            if len(own) > 1:
                words = [w for w, _ in own]
                near = near_pairs(words, words, m, beginning)  # a word is not near itself
                rows += best(near, own, own)
        for first, second in (pair for (_, one, two, _), pair in held.items() if one != two):
            if first and second:
                near = near_pairs([w for w, _ in first], [w for w, _ in second], m, beginning)
                rows += best(near, first, second) + best(near.T, second, first)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    tile = None
    for batch in batches:
        for m, beginning, anchor, one, two, blocks, block, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            now = (anchor, one, two, blocks)
            if (m, beginning) != kind or (now != tile and size >= max(2, min(BLOCK, CELLS // m))):
                yield from compared()
                held, size, kind = {}, 0, (m, beginning)
            tile = now
            held.setdefault(now, ([], []))[int(block != one)].append((word, n))
            size += 1
    yield from compared()


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best``: how many other words are one edit from it, and the one of them of
    largest ``n`` (ties: smallest in code-point order).  Words near no other give no row.  ``words`` has
    ``word, n``, each word once."""
    longer = words.select("word", "n", F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("m"))
    sides = longer.select("word", "n", "m", F.explode(F.array(F.lit(True), F.lit(False))).alias("beginning"))
    half = F.expr("m div 2").cast("int")
    anchored = sides.where(F.char_length("word") >= half).select(
        "word", "n", "m", "beginning",
        F.xxhash64(F.when(F.col("beginning"), F.substring("word", F.lit(1), half)).otherwise(F.substring("word", F.char_length("word") - half + 1, half))).alias("anchor"))
    key = ["m", "beginning", "anchor"]
    # a pair needs two words, the longer of m code points
    sizes = (anchored.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.count_if(F.char_length("word") == F.col("m")).alias("long"))
             .where("size > 1 AND long > 0")
             .select(*key, F.ceil(F.col("size") / F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.lit(CELLS) / F.col("m")))).cast("int").alias("blocks")))
    dealt = anchored.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("word", F.lit("block")), F.col("blocks")).cast("int"))
    tiles = (dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select(*key, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "blocks", "block", "word", "n"))
    schema = "word string, n_near long, best_n long, best string"
    out = arrow_schema(schema)
    # comparing costs far more than reading: small parts are not put together again
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (tiles.repartition(parts, *key, "one", "two").sortWithinPartitions(*key, "one", "two")
             .mapInArrow(lambda batches: _tiles(batches, out), schema))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b"))
            .select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word when following ``word -> form`` from each word, by pointer doubling.
    Chains must end."""
    known = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(known.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def group_variants(words: DataFrame, ratio: float = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table ``word, n`` (each word once, not null).

    A word's form is its near word of largest ``n`` (ties: smallest in code-point order) if that
    is ``ratio`` times its own or more, else null; the root is where its forms end, itself without
    one.  An empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their variants")
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words)
    joined = written(
        words.join(near, "word", "left").withColumn("takes", F.coalesce(F.col("best_n") >= F.col("n") * ratio, F.lit(False)))
        .select("word", F.expr("CASE WHEN takes THEN best END").alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                F.expr("CASE WHEN takes THEN best_n END").alias("form_n")), "near")
    last = roots(joined.where("form IS NOT NULL"))
    return joined.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

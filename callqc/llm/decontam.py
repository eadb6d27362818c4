"""Benchmark decontamination by greedy string tiling.

Words are compared without case and punctuation in any script: texts are decoded, composed
(NFC) and case-folded, and everything that is not a letter, mark or number parts words; in
scripts without spaces (Chinese, Japanese, Thai ...) a character with its marks is a word.
Running Karp-Rabin hashes of ``seed`` words (of all its words for an item of fewer) are
joined between the documents and the benchmark; equal seeds on one diagonal make up the
maximal matches of a document and an item.  Tiling marks the longest match, then the
longest of what is unmarked on both sides, and so on, so passages count wherever they stand
and in any order, and no word of the item counts twice.  A document is contaminated by an
item when its tiles cover at least ``coverage`` of the item's words.

The benchmark is the smaller side: it is held in blocks of at most about ``BLOCK_BYTES`` of
text, one at a time.  Documents meet a single block on the way; with more blocks the texts are
read once for each, so that time grows with the documents times the blocks.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.llm.common import as_bytes, free_name, giving_back, written

SEED_WORDS, COVERAGE = 4, 0.6
#: Text of the benchmark that the driver and a task hold at once.
BLOCK_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Scripts that part no words by spaces: a character, with the marks on it, is a word.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF),
    (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x303C), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0xA4CF), (0xA980, 0xA9DF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
    (0x17000, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF))
_ASCII = bytes(c if chr(c).isalnum() else 0x20 for c in range(128)).lower() + b" " * 128


def unspaced(c: int) -> bool:
    return any(a <= c <= b for a, b in UNSPACED)


@cache
def _word_pattern() -> re.Pattern:
    """A word: letters, marks and numbers of any script; one character and its marks where no spaces part words."""
    kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    alone = {c for a, b in UNSPACED for c in range(a, b + 1) if kind[c] in "LN"}

    def ranges(codes) -> str:
        out: list[list[int]] = []
        for c in codes:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
        return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out) + "]"

    def run(low: int, high: int) -> str:
        return ranges(c for c in range(low, high) if kind[c] in "LMN" and c not in alone)

    marks = ranges(c for c in range(0x10000) if kind[c] == "M")
    # the many ranges above U+FFFF are looked through only for characters there
    return re.compile(f"{ranges(sorted(alone))}{marks}*+|(?:{run(0, 0x10000)}++|(?=[\U00010000-\U0010ffff]){run(0x10000, 0x110000)}++)++")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, canonically composed and case-folded; ASCII texts take a shorter way to the same."""
    text = text or b""
    if text.isascii():
        return text.translate(_ASCII).split()
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text.decode("utf-8", "replace")).casefold())
    return [w.encode() for w in _word_pattern().findall(folded)]


def _rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` ids, modulo 2**64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _BASE + ids[k : k + n].astype(np.uint64)
    return out


@dataclass
class Seeds:
    """Places of the seeds of one width by hash."""

    hashes: np.ndarray  # different seed hashes, sorted; places[first[k]:first[k + 1]] have hashes[k]
    first: np.ndarray
    places: np.ndarray  # item, place


@dataclass
class Block:
    """Items of a part of the benchmark: word ids and their seeds by width."""

    names: list
    items: list[np.ndarray]
    lengths: np.ndarray
    vocabulary: dict[bytes, int]
    seeds: dict[int, Seeds]


def build(names: list, texts: list[bytes | None], width: int) -> Block:
    """Index of items; one of fewer words than a seed is one seed of its own length, one without words is left out."""
    vocabulary: dict[bytes, int] = {}
    own, items = [], []
    for name, text in zip(names, texts, strict=True):
        if words := words_of(text):
            own.append(name)
            items.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64))
    lengths = np.array([len(ids) for ids in items], np.int64)
    seeds = {}
    for size in np.unique(np.minimum(lengths, width)).tolist():
        hashes = [(k, _rolling(ids, size)) for k, ids in enumerate(items) if min(len(ids), width) == size]
        places = np.array([(k, i) for k, h in hashes for i in range(len(h))], np.int64).reshape(-1, 2)
        flat = np.concatenate([h for _, h in hashes])
        order = np.argsort(flat, kind="stable")
        different, first = np.unique(flat[order], return_index=True)
        seeds[size] = Seeds(different, np.append(first, len(flat)), places[order])
    return Block(own, items, lengths, vocabulary, seeds)


def tiles(item: np.ndarray, doc: np.ndarray, i: np.ndarray, j: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from the equal seeds at places ``i`` of the item and ``j`` of the text.

    Returns (place in the item, place in the text, words), longest first; ties go to the
    smallest places.
    """
    order = np.lexsort((j, j - i))
    i, j = i[order], j[order]
    cut = np.flatnonzero((np.diff(j - i) != 0) | (np.diff(j) != 1)) + 1
    starts, stops = np.concatenate(([0], cut)), np.concatenate((cut, [len(i)]))
    heap = [(-(int(t - s) + width - 1), int(i[s]), int(j[s])) for s, t in zip(starts, stops, strict=True)]
    heapq.heapify(heap)
    item_free, doc_free = np.ones(len(item), bool), np.ones(len(doc), bool)
    out = []
    while heap:
        size, a, b = heapq.heappop(heap)
        size = -size
        free = item_free[a : a + size] & doc_free[b : b + size]
        if free.all():
            item_free[a : a + size] = doc_free[b : b + size] = False
            out.append((a, b, size))
        elif free.any():  # what is left of it waits for its turn
            edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
            for s, t in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if t - s >= width:
                    heapq.heappush(heap, (-(t - s), a + s, b + s))
    return out


def _hits(seeds: Seeds, ids: np.ndarray, known: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Items, places in them, places in the text and widths of the equal seeds; ``known`` counts known words."""
    places = np.flatnonzero(known[width:] - known[:-width] == width)  # windows of known words alone
    h = _rolling(ids, width)[places]
    at = np.minimum(np.searchsorted(seeds.hashes, h), len(seeds.hashes) - 1)
    hit = seeds.hashes[at] == h
    places, at = places[hit], at[hit]
    counts = seeds.first[at + 1] - seeds.first[at]
    seed = np.repeat(seeds.first[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    item, i = seeds.places[seed].T
    return item, i, np.repeat(places, counts), np.full(len(item), width)


def matches(block: Block, text: bytes | None, coverage: float = 0.0) -> list[tuple[int, float, int]]:
    """(item number, covered share of the item, tiles) of items that share a seed.

    The words under an item's seeds bound what its tiles can cover; items are tiled from the
    highest bound down, and those whose bound is below both ``coverage`` and the best share so
    far are left out, so every item covered enough and the best one are there.
    """
    words = words_of(text)
    get = block.vocabulary.get
    ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    known = np.concatenate(([0], np.cumsum(ids != 0)))
    found_seeds = [_hits(seeds, ids, known, width) for width, seeds in block.seeds.items() if len(words) >= width]
    if not found_seeds:
        return []
    item, i, j, width = (np.concatenate(x) for x in zip(*found_seeds, strict=True))
    if not len(item):
        return []
    order = np.lexsort((i, item))
    item, i, j, width = item[order], i[order], j[order], width[order]
    starts = np.concatenate(([0], np.flatnonzero(np.diff(item)) + 1))
    stops = np.append(starts[1:], len(item))
    # a seed adds at most the words since the seed before it, and at most its width
    adds = np.minimum(np.diff(i, prepend=0), width)
    adds[starts] = width[starts]
    bounds = np.add.reduceat(adds, starts) / block.lengths[item[starts]]
    out, best = [], 0.0
    for g in np.argsort(-bounds, kind="stable").tolist():
        if bounds[g] < coverage and bounds[g] <= best:
            break
        k, x, y = int(item[starts[g]]), i[starts[g] : stops[g]], j[starts[g] : stops[g]]
        own = int(width[starts[g]])
        same = (block.items[k][x[:, None] + np.arange(own)] == ids[y[:, None] + np.arange(own)]).all(axis=1)
        if same.any():  # equal hashes are checked word by word
            found = tiles(block.items[k], ids, x[same], y[same], own)
            share = sum(n for _, _, n in found) / len(block.items[k])
            out.append((k, share, len(found)))
            best = max(best, share)
    return out


def _match(
    docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, width: int,
    coverage: float, block_bytes: int, best: str, covering: str,
) -> DataFrame:
    """``docs`` with the columns ``best`` (share of the best covered item) and ``covering`` (items covered enough).

    One block goes along with the documents.  Of several, each has a pass of its own over the
    texts, whose hits are written by text and joined at the end; the driver and a task hold one
    block at a time.
    """
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # dealt by a hash so that each has about block_bytes at most
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    part = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(n))
    none = F.expr(f"cast(array() as array<struct<item_id:{benchmark.schema[item_col].dataType.simpleString()},coverage:double,tiles:int>>)")

    def with_hits(df: DataFrame, text: str, k: int) -> tuple[DataFrame, Broadcast]:
        """``df`` with the hits of block ``k``."""
        table = items.where(part == k).orderBy("id", "text").toArrow()
        shared = df.sparkSession.sparkContext.broadcast(build(table["id"].to_pylist(), as_bytes(table["text"].combine_chunks()), width))
        at, columns = df.columns.index(text), len(df.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                most, hits = batch.column(columns).to_pylist(), batch.column(columns + 1).to_pylist()
                for r, value in enumerate(as_bytes(batch.column(at))):
                    for item, share, count in matches(own, value, coverage):
                        most[r] = max(most[r], share)
                        if share >= coverage:
                            hits[r].append({"item_id": own.names[item], "coverage": share, "tiles": count})
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:columns], pa.array(most, pa.float64()), pa.array(hits, batch.schema.field(columns + 1).type)],
                    schema=batch.schema)

        plain = df.select("*", F.lit(0.0).alias(best), none.alias(covering))
        return plain.mapInArrow(giving_back(run), plain.schema), shared

    if n == 1:
        return with_hits(docs, text_col, 0)[0]
    key, text = free_name(docs, "key"), free_name(docs, "whole_text")
    keyed = docs.withColumn(key, F.sha2(F.col(f"`{text_col}`").cast("binary"), 256))
    texts, found = keyed.select(key, F.col(f"`{text_col}`").alias(text)).where(F.col(text).isNotNull()), None
    for k in range(n):
        hits, shared = with_hits(texts, text, k)
        # copies of a text have the same hits
        hits = written(hits.where(F.col(best) > 0).drop(text).dropDuplicates([key]), "decontam-hits")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy(key).agg(F.max(best).alias(best), F.flatten(F.collect_list(covering)).alias(covering))
    return keyed.join(found, key, "left").select(
        *(F.col(f"`{c}`") for c in docs.columns), F.coalesce(best, F.lit(0.0)).alias(best), F.coalesce(covering, none).alias(covering))


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", seed_words: int = SEED_WORDS, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, contaminated, best_coverage, n_items, items`` for every row of ``docs``.

    ``items`` has ``item_id, coverage, tiles`` of every item covered enough, best first (ties
    by item).  Null and empty texts hold nothing; an item of fewer words than a
    seed matches where all its words stand together; null items and items without words match nothing; repeated items and rows count each for itself.  Empty tables give
    an empty result, or one without matches; other columns are not read.
    """
    used = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _match(used, benchmark, "text", item_col, item_text_col, seed_words, coverage, block_bytes, "_best", "_items")
    ordered = F.array_sort("_items", lambda x, y: F.when(x["coverage"] > y["coverage"], -1)
                           .when(x["coverage"] < y["coverage"], 1).when(x["item_id"] < y["item_id"], -1)
                           .when(x["item_id"] > y["item_id"], 1).otherwise(0))
    return found.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.col("_best").alias("best_coverage"),
                        F.size("_items").cast("long").alias("n_items"), ordered.alias("items"))


def clean(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    seed_words: int = SEED_WORDS, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their columns, whatever their names.

    Each row is judged by its own text, so null and repeated ids play no part and repeated rows stay or
    go together; null and empty texts hold nothing and stay; ties cannot arise, as any one item
    suffices; an empty table stays empty, and an empty benchmark removes nothing.
    """
    best, covering = free_name(docs, "best"), free_name(docs, "covering")
    found = _match(docs, benchmark, text_col, item_col, item_text_col, seed_words, coverage, block_bytes, best, covering)
    return found.where(F.size(covering) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))

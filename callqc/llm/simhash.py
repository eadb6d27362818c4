"""SimHash near-dedup: fingerprints of word shingles, linked through a byte-position index.

A fingerprint has eight bytes at eight positions.  Two fingerprints that differ in at most
``d`` bits share at least ``8 - d`` positional bytes, so the count filter keeps a pair when
its tally of shared positional bytes reaches ``8 - d``.  Single postings (position, byte)
hold a 256th of all fingerprints each, and crossing them would grow with the square of the
input; the index therefore is keyed by the intersections that decide the tally: one
posting for each choice of ``8 - d`` positions and their bytes (28 for ``d = 2``).  A pair
reaches the tally exactly when it meets in one of them.  The fingerprints of one posting
differ in ``d`` bytes only, so a posting never has more than ``256 ** d`` distinct ones
whatever the input; members are tallied and verified there, and each posting gives one link
for a member (to the smallest of its verified component) rather than its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.llm.common import connected_components, giving_back, map_texts, with_rows, written

SHINGLE, MAX_BITS, SEED = 3, 2, 42
BYTES = 8
#: Postings with at most so many members compare them in one matrix.
MATRIX = 256
#: Fingerprints of more than this share of all rows (fewer than 1000, so) are joined by a broadcast.
HOT_SHARE = 1 / 1000
#: Keys over which the members of one component are spread.
SALTS = 32
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text: bit i is set if it is set in over half the shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, len(starts), BLOCK):
        some = [digest(joined[s:t], SEED) for s, t in zip(starts[i : i + BLOCK], stops[i : i + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """``doc_id, row, fp`` (the 64 bits as a long) for every row; a null or empty text has 0.  ``row`` is
    ``row_col``, a long, or null."""

    def rows(batches):
        for ids, row, texts in batches:
            yield ids, row, np.array([fingerprint(t, shingle) for t in texts], "<u8").view("<i8")

    row = F.col(row_col) if row_col else F.lit(None)
    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), row.cast("long").alias("row"), F.col(text_col).alias("text")),
                     ["doc_id", "row"], "text", "doc_id long, row long, fp long", rows)


def _components(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``size`` members over the links ``i - j``."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(fps: np.ndarray, masks: np.ndarray, shift: tuple[int, ...], shared: int, bits: int) -> np.ndarray:
    """Local component label of each (distinct) fingerprint of one posting."""
    n = len(fps)
    if n <= MATRIX:
        i, j = np.triu_indices(n, 1)
        x = fps[i] ^ fps[j]
        tally = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
        near = (tally >= shared) & (np.bitwise_count(x) <= bits)
        return _components(n, i[near], j[near])
    # The free bytes alone tell the members apart: look each member's neighbours up by them.
    free = sum(((fps >> np.uint64(8 * p)) & np.uint64(255)) << np.uint64(8 * k) for k, p in enumerate(shift))
    order = np.argsort(free)
    free = free[order]
    label = np.arange(n)
    while True:
        new = label.copy()
        for m in masks:
            at = np.minimum(np.searchsorted(free, free ^ m), n - 1)
            new = np.where(free[at] == free ^ m, np.minimum(new, new[at]), new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    # labels are places in the order of the free bytes; give the smallest place of each component
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def links(distinct: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links ``a, b`` that connect the distinct fingerprints ``fp`` at ``bits`` or fewer differing bits.

    They connect exactly those, though not each pair directly: within a posting every member
    links to one member of its verified component.
    """
    if not 0 < bits < BYTES:
        raise ValueError("bits must be between 1 and 7")
    shared = BYTES - bits
    kept = list(combinations(range(BYTES), shared))
    free = [tuple(p for p in range(BYTES) if p not in k) for k in kept]
    signed = [sum(255 << (8 * p) for p in k) for k in kept]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in signed]
    flips = [sum(1 << b for b in c) for n in range(1, bits + 1) for c in combinations(range(8 * bits), n)]
    masks = np.array(flips, np.uint64)
    index = distinct.select(
        F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("positions", "bytes"),
        "fp")

    def posting(k: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = _links(fps, masks, free[k], shared, bits)
        other = label != np.arange(len(fps))
        return fps[other], fps[label[other]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        ended = False
        batches = iter(batches)
        while not ended:
            batch = next(batches, None)
            ended = batch is None
            if not ended:
                new = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
                rest = tuple(np.concatenate(x) for x in zip(rest, new, strict=True))
            k, key, fps = rest
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], cuts)) if len(k) else np.empty(0, np.int64)
            if ended:
                whole, last = np.concatenate((starts, [len(k)])) if len(k) else starts, len(k)
            else:  # the last posting may go on in the next batch
                whole, last = starts, starts[-1] if len(starts) else 0
            several = np.flatnonzero(np.diff(whole) > 1)
            found = [posting(int(k[s]), fps[s:t]) for s, t in zip(whole[several], whole[several + 1], strict=True)]
            rest = tuple(x[last:] for x in rest)
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return (index.repartition("positions", "bytes").sortWithinPartitions("positions", "bytes")
            .mapInArrow(giving_back(run), "a long, b long"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = MAX_BITS,
    row_col: str | None = None,
) -> DataFrame:
    """``doc_id, fp, component_id, component, row`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of fingerprints that differ in
    ``bits`` or fewer bits.  Null and empty texts, and texts of white space, have the
    fingerprint 0 and are linked by it like any other.  Texts of fewer words than a shingle
    are one shingle.  Repeated rows are copies of each other and keep a row each; a row
    without an id takes part and has the component of its fingerprint, which is null only
    where no row of the component has an id.  ``component`` is a fingerprint of the component, the
    same for all its rows, and ``row`` is ``row_col``.  An empty table gives an empty result; other
    columns of ``docs`` are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle, row_col), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "simhash-distinct")
    nodes = connected_components(links(distinct.select("fp"), bits), "a", "b").withColumnRenamed("node", "fp")
    smallest = nodes.join(distinct.select("fp", "first"), "fp").groupBy("rep").agg(F.min("first").alias("component_id"))
    # a component may hold a third of all fingerprints: its members are spread over SALTS keys
    spread = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = (nodes.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(spread, ["rep", "salt"])
              .select("fp", "component_id", "rep"))
    classes = (distinct.join(linked, "fp", "left")
               .select("fp", "copies", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("rep", "fp").alias("component")))
    classes = written(classes, "simhash-classes")
    rows = distinct.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") > F.lit(rows * HOT_SHARE)
    # a fingerprint of very many copies would put them all under one key of a shuffle
    hot = F.broadcast(classes.where(is_hot).drop("copies"))
    return (prints.join(hot, "fp").unionByName(
        prints.join(hot, "fp", "left_anti").join(classes.where(~is_hot).drop("copies"), "fp"))
        .select("doc_id", "fp", "component_id", "component", "row"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of every component, with the columns of ``docs``: that of the smallest id, rows
    without an id last, then of the smallest fingerprint.

    So every distinct text is represented: null ids, and ids that repeat with different texts,
    lose no component; of repeated rows one stays.  Null and empty texts are copies of each
    other.  An empty table stays empty; columns of any name are kept.
    """
    rows, row = with_rows(docs, "simhash-docs")
    found = near_duplicates(rows, id_col, text_col, row_col=row, **options)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "row"))["row"].alias(row)
    return rows.join(found.groupBy("component").agg(first).select(row), row, "left_semi").drop(row)

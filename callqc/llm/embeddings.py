"""Embedding near-dedup by lattice hashing.

Each of ``TABLES`` random projections maps a unit vector to eight dimensions per block, and
each block is decoded to the nearest point of the E8 lattice, the densest packing of eight
dimensions; the lattice points of the blocks name a cell.  A vector is filed in its own cell
and asks, besides, the neighbouring cells its projection is nearest to.  Two vectors become
candidates where one's cell is among the other's, and are linked if their cosine, in double
precision, reaches the threshold.

Cells are first counted on narrow rows (cell, vector id); only the vectors of cells that can
give a pair are gathered.  A cell of many vectors is dealt into parts, and each pair of parts
is a group of its own, so no task holds more than two parts of a cell.  A pair is counted in
the first table that finds it and nowhere else, and goes out as a count and as links to one
member of its group, never as a row of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.llm.common import connected_components, written

COSINE = 0.98
#: Projections, E8 blocks of each, neighbouring cells asked in each, and the scale of the
#: projection (larger: smaller cells).  The recall for pairs right at the threshold is
#: measured in the tests.
TABLES, BLOCKS, PROBES, SCALE, SEED = 4, 2, 3, 5.0, 7
#: Vectors of a cell (with those that ask it) that one part holds.
PART = 1024


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (integers of an even sum): round, and if the sum is odd turn the worst."""
    r = np.rint(x)
    odd = (r.sum(axis=-1) % 2) != 0
    gap = x - r
    worst = np.abs(gap).argmax(axis=-1)[..., None]
    step = np.where(np.take_along_axis(gap, worst, -1) < 0, -1.0, 1.0)
    turned = r.copy()
    np.put_along_axis(turned, worst, np.take_along_axis(r, worst, -1) + step, -1)
    return np.where(odd[..., None], turned, r)


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8, the union of D8 and D8 moved by a half in every coordinate."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=-1) <= ((x - b) ** 2).sum(axis=-1)
    return np.where(closer[..., None], a, b)


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a in (1, -1):
            for b in (1, -1):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    for signs in range(256):
        if signs.bit_count() % 2 == 0:
            out.append(np.array([-0.5 if signs >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


NEIGHBOURS = neighbours()


class Lattice:
    """Cells of unit vectors: ``cells(x)[:, t, 0]`` is the own cell in table t, the rest are asked."""

    def __init__(self, dims: int, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, seed: int = SEED):
        rng = np.random.default_rng([seed, dims])
        self.tables, self.blocks, self.probes = tables, blocks, probes
        # orthonormal rows where the vectors have enough dimensions, scaled like a random projection
        rows = 8 * blocks
        self.project = []
        for _ in range(tables):
            g = rng.standard_normal((max(dims, rows), rows))
            q = np.linalg.qr(g)[0][:dims] * np.sqrt(max(dims, rows) / rows) * np.sqrt(blocks)
            self.project.append(q * scale / np.sqrt(8))
        self.mix = rng.integers(1, 1 << 62, (tables, blocks, 8), dtype=np.int64) * 2 + 1

    def cells(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            y = (x @ self.project[t]).reshape(len(x), self.blocks, 8)
            c = nearest(y)
            with np.errstate(over="ignore"):
                own = ((2 * c).astype(np.int64) * self.mix[t]).sum(axis=(1, 2))
                out[:, t, 0] = own
                if self.probes:
                    # neighbours over the facets that are nearest, of whichever block
                    toward = ((y - c) @ NEIGHBOURS.T).reshape(len(x), -1)
                    best = np.argsort(-toward, axis=1, kind="stable")[:, : self.probes]
                    moves = ((2 * NEIGHBOURS).astype(np.int64) @ self.mix[t].T).T.ravel()
                    out[:, t, 1:] = own[:, None] + moves[best]
        return out


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` members over the links ``i - j``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _meet(cells: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
    """Whether in a table the own cell of one member is among the cells of the other."""
    a, b = cells[i, table], cells[j, table]
    return (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)


def _group(x: np.ndarray, cells: np.ndarray, side: np.ndarray, table: int, cell: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one group that no earlier table, and no smaller cell of this one, finds.

    ``side`` has the part of each member; two parts are compared with each other, a single
    part with itself.
    """
    if side[0] == side[-1]:
        i, j = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    else:
        k = int(np.searchsorted(side, side[-1]))
        i, j = np.nonzero(x[:k] @ x[k:].T >= cosine)
        j = j + k
    own_i, own_j = cells[i, table, 0], cells[j, table, 0]
    here = (own_i == cell) | (own_j == cell)
    # where both ask the other's own cell they meet in two cells: the smaller one counts
    both = (own_i != own_j) & (cells[j, table] == own_i[:, None]).any(axis=1) & (cells[i, table] == own_j[:, None]).any(axis=1)
    here &= ~both | (np.minimum(own_i, own_j) == cell)
    i, j = i[here], j[here]
    for t in range(table):
        new = ~_meet(cells, i, j, t)
        i, j = i[new], j[new]
    return i, j


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
    tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, part: int = PART,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors are compared if their labels are equal and not null and they have the same number
    of dimensions.  Vectors that are null, empty or zero or hold null or non-finite components,
    and rows without an id, link with nothing (the latter with null ``component_id`` and
    ``kept`` false).  Equal vectors are one class: each counts all others as links.  Repeated
    rows keep a row each and share their id's component.  An empty table gives an empty
    result; other columns are not read.
    """
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    source = F.col(vector_col) if kind == "<f4" else F.col(vector_col).cast("array<double>")
    used = vectors.select(F.col(id_col).cast("long").alias("vec_id"), source.alias("v"), F.col(label_col).cast("string").alias("label"))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, raws = [], []
            for i, v, label in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                x = np.array(v, kind) + 0.0 if v and label is not None and i is not None and None not in v else None
                good = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
                raws.append(x.astype(kind).tobytes() if good else None)
                classes.append(hashlib.blake2b(label.encode() + b"\0" + raws[-1], digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(classes, pa.binary()), pa.array(raws, pa.binary())],
                ["vec_id", "label", "class", "v"])

    filed = used.mapInArrow(file, "vec_id long, label string, class binary, v binary")
    # all rows of a class are the same bytes and label, so any of them serves
    classes = written(filed.where("class IS NOT NULL").groupBy("class").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")), "vectors")

    def lattice(dims: int) -> Lattice:
        return Lattice(dims, tables, blocks, probes, scale)

    def cells_of(raw: list[bytes], labels: list[str], made: dict[int, Lattice]) -> np.ndarray:
        """Cells of vectors, told apart by table, label and dimensions."""
        out = np.empty((len(raw), tables, 1 + probes), np.int64)
        by: dict[int, list[int]] = {}
        for k, v in enumerate(raw):
            by.setdefault(len(v), []).append(k)
        for size, own in by.items():
            if size not in made:
                made[size] = lattice(size // int(kind[-1]))
            out[own] = made[size].cells(_unit([raw[k] for k in own], kind))
        salt = np.array([int.from_bytes(hashlib.blake2b(f"{size} {label}".encode(), digest_size=8).digest(), "little", signed=True)
                         for size, label in zip(map(len, raw), labels, strict=True)], np.int64)
        with np.errstate(over="ignore"):
            return out + salt[:, None, None] + (np.arange(tables, dtype=np.int64) * 0x632BE59BD9B4E019)[None, :, None]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lattice] = {}
        for batch in batches:
            if batch.num_rows:
                cells = cells_of(batch.column(2).to_pylist(), batch.column(1).to_pylist(), made)
                n, width = len(cells), tables * (1 + probes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.ravel()), pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), n)),
                     pa.array(np.tile(np.arange(width) % (1 + probes) == 0, n)),
                     batch.column(0).take(pa.array(np.repeat(np.arange(n), width)))], ["cell", "table", "own", "class"])

    cells = classes.select("class", "label", "v").mapInArrow(narrow, "cell long, table int, own boolean, class binary")
    cells = written(cells, "cells")
    counts = (cells.groupBy("cell", "table").agg(F.count("*").alias("members"), F.count_if("own").alias("owners"))
              .where("owners > 0 AND members > 1").select("cell", "table", F.ceil(F.col("members") / part).cast("int").alias("parts")))
    own_part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    dealt = (cells.join(counts, ["cell", "table"]).withColumn("side", own_part)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("cell", "table", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "class"))
    gathered = dealt.join(classes.select("class", "node", "n", "label", "v"), "class")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lattice] = {}
        held: list[pa.RecordBatch] = []
        schema = None

        def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([table.column(c).to_numpy() for c in range(4)], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(key)]))
            raw, labels = table.column(8).to_pylist(), table.column(7).to_pylist()
            side, node, n = (table.column(c).to_numpy() for c in (4, 5, 6))
            for s, t in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                # members of another label or size meet by a clash of hashes only
                kinds = [(len(raw[k]), labels[k]) for k in range(s, t)]
                for one in set(kinds):
                    own = np.array([s + k for k, x in enumerate(kinds) if x == one])
                    if len(own) < 2:
                        continue
                    some, same = [raw[k] for k in own], [labels[k] for k in own]
                    i, j = _group(_unit(some, kind), cells_of(some, same, made), side[own], int(key[s, 1]), int(key[s, 0]), cosine)
                    if len(i):
                        links = np.bincount(i, weights=n[own][j], minlength=len(own)) + np.bincount(j, weights=n[own][i], minlength=len(own))
                        label = _components(len(own), i, j)
                        hit = np.flatnonzero(links)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(node[own][hit]), pa.array(links[hit].astype(np.int64)), pa.array(node[own][label[hit]])],
                            ["node", "links", "to"])

        for batch in batches:
            schema = batch.schema
            held.append(batch)
            table = pa.Table.from_batches(held)
            last = [table.column(c)[-1].as_py() for c in range(4)]
            first_of_last = table.num_rows
            key = np.stack([table.column(c).to_numpy() for c in range(4)], axis=1)
            same = (key == np.array(last)).all(axis=1)
            first_of_last = int(np.argmax(same))
            yield from groups(table.slice(0, first_of_last)) if first_of_last else ()
            held = table.slice(first_of_last).combine_chunks().to_batches()
        if held and schema is not None:
            yield from groups(pa.Table.from_batches(held))

    order = ["cell", "table", "p", "q"]
    found = written(
        gathered.select(*order, "side", "node", "n", "label", "v").repartition(*order).sortWithinPartitions(*order, "side", "node")
        .mapInArrow(link, "node long, links long, to long"), "vector-links")
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = connected_components(found, "node", "to")
    smallest = nodes.groupBy("rep").agg(F.min("node").alias("component_id"))
    nodes = nodes.join(smallest, "rep").select("node", "component_id")
    result = (classes.select("class", "node", "n").join(degree, "node", "left").join(nodes, "node", "left")
              .select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("component_id", "node").alias("component_id")))
    return (filed.select("vec_id", "class").join(result, "class", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))

"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs to).
Words flow from each pattern, which has the words of its documents once, twice ... up to
``max_repeats`` times at rising costs (convex: nothing is repeated before the rest is used),
through the sources of the pattern to the sources' quotas.  The cheapest largest flow says
how many words each pattern gives; within a pattern the documents of the smallest seeded
hashes are taken until that many words are reached.

The flow is solved on the driver on one node per pattern and source, numbers that do not
grow with the documents; a source that no document shares with another needs no search.
"""

from __future__ import annotations

import heapq
from collections.abc import Hashable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callqc.llm.common import short_table, written

MAX_REPEATS = 3
#: Patterns whose table goes along with every task; more are joined like any table.
BROADCAST_PATTERNS = 20_000
#: Documents of a pattern that one task orders exactly; all others are taken by ranges of their hash.
RANGE_DOCS = 2048
#: Keys over which equal rows (one id and content, or none) are numbered.
SALTS = 64
SEED = 9


def targets(sizes: Sequence[float], weights: Sequence[float], max_repeats: float = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight; a target stops at ``max_repeats`` times its size.

    What is above is shared anew by weight among the others until none is above.
    """
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[k] for k in free)
        share = {k: left * weights[k] / total for k in free} if total else dict.fromkeys(free, 0.0)
        above = [k for k in free if share[k] > max_repeats * sizes[k]]
        if not above:
            for k in free:
                out[k] = share[k]
            break
        for k in above:
            out[k] = float(max_repeats * sizes[k])
            left -= out[k]
        free = [k for k in free if k not in set(above)]
    return out


def flow(
    patterns: Sequence[tuple[int, Sequence[int]]], quotas: Sequence[int], max_repeats: int = MAX_REPEATS
) -> list[dict[int, int]]:
    """Words that each pattern (words, its sources) gives to each source at the least cost.

    Patterns and sources that no chain of overlaps connects are solved apart.
    """
    part = list(range(len(quotas)))

    def top(k: int) -> int:
        while part[k] != k:
            part[k] = k = part[part[k]]
        return k

    for _, sources in patterns:
        for k in sources[1:]:
            part[top(k)] = top(sources[0])
    together: dict[int, list[int]] = {}
    for p, (_, sources) in enumerate(patterns):
        if sources:
            together.setdefault(top(sources[0]), []).append(p)
    out: list[dict[int, int]] = [{} for _ in patterns]
    for own in together.values():
        if len(own) == 1 and len(patterns[own[0]][1]) == 1:
            (words, (k,)), p = patterns[own[0]], own[0]
            out[p] = {k: take} if (take := min(max_repeats * words, quotas[k])) > 0 else {}
            continue
        used = sorted({k for p in own for k in patterns[p][1]})
        at = {k: i for i, k in enumerate(used)}
        given = _flow([(patterns[p][0], [at[k] for k in patterns[p][1]]) for p in own], [quotas[k] for k in used], max_repeats)
        for p, f in zip(own, given, strict=True):
            out[p] = {used[i]: x for i, x in f.items()}
    return out


def _flow(patterns: Sequence[tuple[int, Sequence[int]]], quotas: Sequence[int], max_repeats: int) -> list[dict[int, int]]:
    """Successive cheapest paths with node potentials; the arcs into a pattern cost 1 for the
    first use of its words, 2 for the second and so on.
    """
    n, s = len(patterns), len(quotas)
    head: list[list[int]] = [[] for _ in range(n + s + 2)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, r, c in ((a, b, capacity, price), (b, a, 0, -price)):
            head[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(c)
        return len(to) - 2

    start, end = n + s, n + s + 1
    given: list[dict[int, int]] = []
    for p, (words, sources) in enumerate(patterns):
        for level in range(1, max_repeats + 1):
            arc(start, p, words, level)
        given.append({k: arc(p, n + k, max_repeats * words, 0) for k in sources})
    for k, quota in enumerate(quotas):
        arc(n + k, end, quota, 0)
    potential = [0] * (n + s + 2)
    while True:
        far: list[float] = [float("inf")] * (n + s + 2)
        by = [-1] * (n + s + 2)
        far[start] = 0
        heap = [(0.0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in head[a]:
                new = d + cost[e] + potential[a] - potential[to[e]]
                if room[e] > 0 and new < far[to[e]]:
                    far[to[e]], by[to[e]] = new, e
                    heapq.heappush(heap, (new, to[e]))
        if by[end] < 0:
            break
        potential = [int(p + min(d, far[end])) for p, d in zip(potential, far, strict=True)]
        path, at = [], end
        while at != start:
            path.append(by[at])
            at = to[by[at] ^ 1]
        least = min(room[e] for e in path)
        for e in path:
            room[e] -= least
            room[e ^ 1] += least
    return [{k: room[e + 1] for k, e in arcs.items() if room[e + 1]} for arcs in given]


def _fill(group: pd.DataFrame) -> pd.DataFrame:
    """Of one range of a pattern: how many of the ``copies`` of each hash and size, in seeded order,
    still fit the rest of its words."""
    group = group.sort_values(["hash", "size"], kind="stable")
    rest, size, copies = int(group["rest"].iloc[0]), group["size"].to_numpy(), group["copies"].to_numpy()
    fit = np.zeros(len(group), np.int64)
    for k, n in enumerate(size.tolist()):
        if n > 0:
            fit[k] = min(int(copies[k]), rest // n)
            rest -= int(fit[k]) * n
    left = np.flatnonzero((fit < copies) & (size > 0))
    if rest and len(left):  # one more if that comes nearer
        k = left[size[left].argmin()]
        fit[k] += abs(size[k] - rest) < rest
    return group.assign(fit=fit)[["pattern", "hash", "size", "fit"]]


def mix(
    docs: DataFrame, members: Column, size: Column, id_col: str = "doc_id",
    weights: dict[Hashable, float] | None = None, max_repeats: int = MAX_REPEATS, seed: int = SEED,
    content: Column | None = None, row: Column | None = None,
) -> tuple[DataFrame, dict[Hashable, tuple[int, float]]]:
    """Repeats of every document, and each source's (words, target).

    ``members`` is the array of sources of a document (null stands for an unnamed source; an
    empty or null array for none, and such documents are not taken), ``size`` its words.
    ``weights`` maps sources to their weights; without it sources in code point order, null
    last, weigh 1, 2, 3, 1, 2, 3 and so on.  Returns ``doc, size, members, taken`` per row,
    ``taken`` being the words with repeats: a document is taken whole, 0 to ``max_repeats``
    times.  Documents without words are never taken.  The seeded hash is of the id and of ``content``
    (a hash of the text, say), which tells documents of a null or repeated id apart; rows that
    agree in both count each, and any of them may be the ones taken.  ``row``, a number of the row,
    comes back as the column ``row``.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    number = [F.coalesce(row, F.lit(None)).cast("long").alias("row")] if row is not None else []
    rows = written(docs.select(
        F.col(id_col).alias("doc"), size.cast("long").alias("size"),
        F.array_sort(F.array_distinct(F.coalesce(members.cast("array<string>"), F.array().cast("array<string>")))).alias("members"),
        F.xxhash64(F.col(id_col).cast("string"), F.lit(0) if content is None else content, F.lit(seed)).alias("hash"),
        F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"), *number), "mix-rows")
    found = rows.groupBy("members").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).collect()
    found.sort(key=lambda r: [(m is None, m or "") for m in r["members"]])
    sources = sorted({m for r in found for m in r["members"]}, key=lambda m: (m is None, m or ""))
    place_of = {m: k for k, m in enumerate(sources)}
    words = [0] * len(sources)
    for r in found:
        for m in r["members"]:
            words[place_of[m]] += r["words"]
    share = [float(weights.get(m, 0)) for m in sources] if weights is not None else [k % 3 + 1.0 for k in range(len(sources))]
    wanted = targets(words, share, max_repeats)
    if any(len(r["members"]) > 1 for r in found):  # overlaps: the total is that of the documents
        total, held = sum(r["words"] for r in found if r["members"]), sum(words)
        wanted = [x * total / held for x in wanted] if held else wanted
    given = flow([(r["words"], [place_of[m] for m in r["members"]]) for r in found], [round(x) for x in wanted], max_repeats)
    plan = []
    for k, (r, f) in enumerate(zip(found, given, strict=True)):
        take, own = sum(f.values()), r["words"]
        whole = take // own if own else 0
        plan.append((k, r["members"], int(whole), int(take - whole * own), max(1, -(-r["docs"] // RANGE_DOCS))))
    table = short_table(spark, plan, "pattern int, members array<string>, whole long, wanted long, ranges long")
    table = F.broadcast(table) if len(plan) <= BROADCAST_PATTERNS else table
    span = (F.pmod(F.col("hash"), F.lit(1 << 30)) * F.col("ranges") / F.lit(1 << 30)).cast("long")
    rows = rows.join(table, "members").withColumn("range", span)
    sums = rows.groupBy("pattern", "range").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    # ranges of a pattern are a 2048th of its documents
    before = F.sum("words").over(Window.partitionBy("pattern").orderBy("range")) - F.col("words")
    edge = (sums.withColumn("before", before).where("before <= wanted AND before + words > wanted")
            .groupBy("pattern").agg(F.min("range").alias("edge"), F.min_by(F.col("wanted") - F.col("before"), "range").alias("rest")))
    edge = F.broadcast(edge) if len(plan) <= BROADCAST_PATTERNS else edge
    rows = rows.join(edge, "pattern", "left")
    kept = ["doc", "size", "pattern", *(["row"] if number else [])]
    plain = rows.where("edge IS NULL OR range <> edge").select(
        *kept, F.when(F.col("range") < F.col("edge"), 1).otherwise(0).cast("long").alias("extra"))
    # in the range where a pattern's words end, equal rows are counted, not gathered
    at_edge, same = rows.where("range = edge"), ["pattern", "hash", "size"]
    per_salt = at_edge.groupBy(*same, "salt").agg(F.count(F.lit(1)).alias("copies"), F.first("rest").alias("rest"))
    fits = (per_salt.groupBy(*same).agg(F.sum("copies").alias("copies"), F.first("rest").alias("rest")).groupBy("pattern")
            .applyInPandas(_fill, "pattern int, hash long, size long, fit long"))
    earlier = F.sum("copies").over(Window.partitionBy(*same).orderBy("salt")) - F.col("copies")
    fits = per_salt.select(*same, "salt", earlier.alias("earlier")).join(fits, same).select(*same, "salt", (F.col("fit") - F.col("earlier")).alias("fit"))
    place = F.row_number().over(Window.partitionBy(*same, "salt").orderBy("doc"))
    mixed = at_edge.withColumn("place", place).join(fits, [*same, "salt"]).select(*kept, (F.col("place") <= F.col("fit")).cast("long").alias("extra"))
    out = plain.unionByName(mixed).join(table.select("pattern", "members", "whole"), "pattern")
    taken = (F.least(F.col("whole") + F.col("extra"), F.lit(max_repeats)) * F.col("size")).alias("taken")
    return out.select("doc", "size", "members", taken, *(["row"] if number else [])), {m: (words[k], wanted[k]) for m, k in place_of.items()}

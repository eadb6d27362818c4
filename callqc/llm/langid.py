"""Language identification by prediction by partial matching (PPM) over bytes.

One context tree per language holds how often each byte followed each context of up to
``ORDER`` bytes in the training texts.  After training the statistics are frozen: the
probability of a byte in its longest known context is ``n(byte) / (n + kinds)`` (escape
method C), and bytes the context has not seen share the escape mass ``kinds / (n + kinds)``
in proportion to their probability in the next shorter context, those already excluded;
so the probabilities of a context add up to exactly one and the code length of a text is
exact.  The shortest code wins.  Because the statistics are frozen the code lengths are laid
out in tables that tasks only read: (context, byte, language) for the contexts up to a byte
shorter than ``ORDER``, and for those of full length the bytes that followed them in a training
text; any other byte costs what it does in the shorter context and the escape.  So the tables
grow with the different runs of ``ORDER + 1`` bytes, not with the texts.

Statistics and ``limits`` come from all labelled rows.

Bytes are folded first: A-Z to lower case, every other ASCII byte that is no letter to one
separator; bytes that no training text has share one more symbol.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callqc.llm.common import as_bytes, giving_back, map_texts

#: Longest context in bytes; with the byte that follows it fits 32 bits.
ORDER = 3
#: Contexts of full length are kept if the training texts have them so often (shorter ones always).
MIN_CONTEXT = 2
#: ``limits``: a language's usual code length is this quantile of all its labelled texts of so many
#: bytes at least; their bits a byte are counted in steps of one in ``LIMIT_STEPS``, rounded up.
LIMIT_BYTES, LIMIT_QUANTILE, LIMIT_STEPS = 200, 0.99, 4096
#: ``keep_known``: a text is in no learned language if its code is longer than this many times the
#: usual one and as many bits more (a short text may hold a name, a number or a key).
MARGIN, SLACK_BITS = 1.5, 256
#: Bytes counted or scored at once.
BLOCK = 1 << 20
#: Rows of a batch held as Python objects at once.
ROWS = 1000
UNKNOWN = "und"


def _fold() -> np.ndarray:
    """Byte -> folded byte: 0 for separators, lower case letters, bytes from 0x80 as they are."""
    out = np.zeros(256, np.uint8)
    for c in range(256):
        lower = bytes([c]).lower()
        if c >= 0x80 or lower.isalpha():
            out[c] = lower[0]
    return out


FOLD = _fold()


ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    """Whether any character of a UTF-8 text is a letter (of any script)."""
    return bool(ASCII_LETTER.search(text)) or (
        not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of ``ROWS``, for a bounded memory."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _blocks(texts: Iterable[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers and bytes of the texts, about ``BLOCK`` bytes at a time.

    Each text begins with ORDER bytes of context, also the next piece of a long one; a block has
    one piece of a text at most.
    """
    numbers, pieces, filled = [], [], 0
    for at, text in enumerate(texts):
        text = bytes(ORDER) + text
        for i in range(ORDER, len(text), BLOCK):
            piece = text[i - ORDER : i + BLOCK]
            numbers.append(at)
            pieces.append(piece)
            filled += len(piece)
            if filled >= BLOCK:
                yield numbers, pieces
                numbers, pieces, filled = [], [], 0
    if numbers:
        yield numbers, pieces


def _packed(symbols: np.ndarray, size: int, n: int) -> np.ndarray:
    """Runs of ``n`` symbols as one integer each, at each place that has ``ORDER`` symbols after it."""
    key = np.zeros(len(symbols) - ORDER, symbols.dtype)
    for i in range(n):
        key *= size
        key += symbols[i : len(symbols) - ORDER + i]
    return key


def _own(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which places of a block are a text's own, and where each text starts among these."""
    # a text's own places come first, then ORDER places that belong to the next text's context
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    own = np.ones(lengths.sum(), bool)
    own[(np.cumsum(lengths)[:, None] - 1 - np.arange(ORDER)).ravel()] = False
    return own[: len(own) - ORDER], np.cumsum(lengths - ORDER) - (lengths - ORDER)


def _grams(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (ORDER context bytes, byte) over whole texts, packed into one integer each."""
    found = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
    for _, pieces in _blocks(texts):
        symbols = FOLD[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.uint32)
        found.append(np.unique(_packed(symbols, 256, ORDER + 1)[_own(pieces)[0]], return_counts=True))
    return _added(found)


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(keys))
    return keys.astype(np.int64), n.astype(np.int64)


@dataclass
class Model:
    """Frozen code lengths in bits."""

    languages: list[str]
    size: int  # symbols
    symbol: np.ndarray  # byte -> symbol
    context: np.ndarray  # ORDER symbols, packed -> row of escape, 0 if the context is not known
    escape: np.ndarray  # [row, language]: what a byte costs more that the context has not seen
    grams: np.ndarray  # known context and a symbol seen there, packed, in order
    cost: np.ndarray  # [row, language]: each symbol in each shorter context, then each of grams

    @property
    def table(self) -> np.ndarray:
        """Code lengths ``[context, symbol, language]`` in the contexts one byte shorter."""
        return self.cost[: self.size**ORDER].reshape(-1, self.size, len(self.languages))

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.languages)))
        for numbers, pieces in _blocks(texts):
            out[numbers] += self._block(pieces)
        return out

    def _block(self, pieces: list[bytes]) -> np.ndarray:
        """Code lengths of texts that each begin with ORDER bytes of context."""
        own, starts = _own(pieces)
        symbols = self.symbol[np.frombuffer(b"".join(pieces), np.uint8)]
        gram = _packed(symbols, self.size, ORDER + 1)[own]
        place = np.searchsorted(self.grams, gram)
        rare = np.flatnonzero(np.take(self.grams, place, mode="clip") != gram) if len(self.grams) else np.arange(len(gram))
        place += self.size**ORDER
        place[rare] = gram[rare] % self.size**ORDER
        more = self.context[gram[rare] // self.size]
        out = np.empty((len(pieces), len(self.languages)))
        for k in range(len(self.languages)):
            bits = self.cost[:, k][place]
            bits[rare] += self.escape[more, k]
            out[:, k] = np.add.reduceat(bits, starts, dtype=np.float64)
        return out


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Tables from each language's (packed grams, counts)."""
    languages = sorted(counts)
    seen = np.zeros(256, bool)
    for keys, _ in counts.values():
        for i in range(ORDER + 1):
            seen[(keys >> (8 * i)) & 255] = True
    seen[0] = True
    folded = np.flatnonzero(seen)
    size = len(folded) + 1  # the last symbol stands for all bytes that were not seen
    rank = np.full(256, size - 1, np.int64)
    rank[folded] = np.arange(len(folded))
    packed = {}
    for lang, (keys, n) in counts.items():
        key = np.zeros(len(keys), np.int64)
        for i in range(ORDER, -1, -1):
            key = key * size + rank[(keys >> (8 * i)) & 255]
        packed[lang] = key, n
    together = np.zeros(size**ORDER)
    for key, n in packed.values():
        together += np.bincount(key // size, weights=n, minlength=len(together))
    full = np.flatnonzero(together >= MIN_CONTEXT)
    context = np.zeros(len(together), np.int32)
    context[full] = np.arange(1, len(full) + 1, dtype=np.int32)
    every = np.unique(np.concatenate([np.zeros(0, np.int64), *(key for key, _ in packed.values())]))
    grams = every[context[every // size] > 0]
    at_gram = context[grams // size] - 1
    short = size ** (ORDER - 1)  # contexts one byte shorter are all there
    cost = np.empty((short * size + len(grams), len(languages)), np.float32)
    escape = np.zeros((1 + len(full), len(languages)), np.float32)
    for at, lang in enumerate(languages):
        key, n = packed[lang]
        prob = np.full((1, size), 1 / size)
        for order in range(ORDER):
            rows = size**order
            tally = np.bincount(key % (rows * size), weights=n, minlength=rows * size).reshape(rows, size)
            # the next shorter context drops the oldest byte, the most significant digit
            prob = _blend(tally, prob[np.arange(rows) % len(prob)])
        cost[: short * size, at] = -np.log2(prob).ravel()
        place = context[key // size] - 1
        by = np.argsort(place, kind="stable")
        key, n, place = key[by], n[by], place[by]
        for i in range(0, len(full), 4096):  # in blocks, for a bounded memory
            rows = min(4096, len(full) - i)
            a, b = np.searchsorted(place, [i, i + rows])
            tally = np.bincount((place[a:b] - i) * size + key[a:b] % size, weights=n[a:b],
                                minlength=rows * size).reshape(rows, size)
            lower = prob[full[i : i + rows] % short]
            bits = -np.log2(_blend(tally, lower))
            # no text has the last symbol, so that one always pays the escape
            escape[1 + i : 1 + i + rows, at] = bits[:, -1] + np.log2(lower[:, -1])
            a, b = np.searchsorted(at_gram, [i, i + rows])
            cost[short * size + a : short * size + b, at] = bits[at_gram[a:b] - i, grams[a:b] % size]
    return Model(languages, size, rank[FOLD].astype(np.int32), context, escape, grams.astype(np.int32), cost)


def _blend(tally: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of a context from its counts and those of the next shorter context."""
    total, kinds = tally.sum(axis=1, keepdims=True), (tally > 0).sum(axis=1, keepdims=True)
    rest = np.where(tally > 0, 0, lower)
    left = rest.sum(axis=1, keepdims=True)
    every = left <= 0  # a context that has seen all symbols needs no escape
    kinds = np.where(every, 0, kinds)
    whole = np.maximum(total + kinds, 1)
    escaped = rest * np.where(total > 0, kinds / whole, 1) / np.where(every, 1, left)
    return np.where(tally > 0, tally / whole, escaped)


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows: Column | None = None, sample_docs: int | None = None,
) -> Model:
    """Frozen statistics from the whole texts of each language.

    ``rows`` restricts the rows to learn from; ``sample_docs``, if given, to about so many texts of
    each language, drawn by a hash of the id (else ids play no part).  Rows of null language or text
    are not used.  Counts are added up in the tasks; the driver gets the different grams.
    """
    used = docs if rows is None else docs.where(rows)
    used = used.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"),
                       F.col(text_col).cast("binary").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    if sample_docs is not None:
        sizes = used.groupBy("lang").agg(F.count("*").alias("n"))
        # a share of the hash range that holds the wanted number; a language with fewer texts gives all
        share = F.lit(float(sample_docs)) / F.col("n")
        drawn = (F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30)))
        used = used.withColumn("drawn", drawn).join(F.broadcast(sizes), "lang").where(F.coalesce(F.col("drawn"), F.lit(0.0)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            places: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column(0).to_pylist()):
                places.setdefault(lang, []).append(i)
            for lang, some in places.items():
                new = _grams(batch.column(1)[i].as_py() for i in some)
                found[lang] = _added([found[lang], new]) if lang in found else new
        for lang, (keys, n) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)],
                                             ["lang", "gram", "n"])

    table = (used.select("lang", "text").mapInArrow(giving_back(count), "lang string, gram long, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().combine_chunks())
    langs = table["lang"].combine_chunks().dictionary_encode()
    at, keys, n = langs.indices.to_numpy(), table["gram"].to_numpy(), table["n"].to_numpy()
    return build({lang: (keys[at == k], n[at == k]) for k, lang in enumerate(langs.dictionary.to_pylist())})


def _decide(m: Model, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, list[float | None]]:
    """Language, score and bits per byte of each text."""
    pred, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
    own = [i for i, t in enumerate(texts) if t and has_letter(t)] if m.languages else []
    if own:
        bits = m.bits([texts[i] for i in own])
        least = bits.min(axis=1)
        weight = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        for i, k, w, b in zip(own, bits.argmin(axis=1).tolist(), weight.tolist(), least.tolist(), strict=True):
            pred[i], score[i], rate[i] = m.languages[k], w, b / len(texts[i])
    return pred, score, rate


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte`` for every row.

    ``score`` is the weight of the winner among the languages at the text's code lengths
    (1 for sure); code lengths that tie go to the language that sorts first.  A null text
    and a text without any letter is ``und`` with score 0 and null ``bits_per_byte``, and so
    is every text under a model without languages.  Repeated rows keep a row each; an empty
    table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for ids, texts in batches:
            yield ids, *_decide(shared.value, texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"], "text",
                     f"doc_id {kind}, lang_pred string, score double, bits_per_byte double", rows)


def limits(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> dict[str, float]:
    """Bits a byte that all but a few labelled texts of each language stay below.

    Every labelled text of ``LIMIT_BYTES`` counts, under the language that the model gives it;
    ids play no part.  A language without such texts has no limit.
    """
    used = docs.where(F.col(lang_col).isin(model.languages) & (F.octet_length(text_col) >= LIMIT_BYTES))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            pred, _, bits = _decide(shared.value, as_bytes(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(pred, pa.string()), pa.array(bits, pa.float64())], ["lang_pred", "bits_per_byte"])

    rated = used.select(text_col).mapInArrow(giving_back(rate), "lang_pred string, bits_per_byte double").where(F.col("lang_pred") != UNKNOWN)
    # the different steps are few, so the quantile over them and their counts is exact
    steps = rated.groupBy("lang_pred", F.ceil(F.col("bits_per_byte") * LIMIT_STEPS).alias("step")).agg(F.count("*").alias("n"))
    # a row per language
    found = steps.groupBy("lang_pred").agg((F.percentile("step", LIMIT_QUANTILE, F.col("n")) / LIMIT_STEPS).alias("limit")).collect()
    return {r.lang_pred: r.limit for r in found}


def keep_known(docs: DataFrame, model: Model, limit: dict[str, float], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are in one of the learned languages.

    Rejected are the texts that ``identify`` calls ``und`` (null, without a letter) and those whose
    code in the best language is longer than ``MARGIN`` times that language's ``limit`` allows and
    ``SLACK_BITS`` more: keyboard noise, encoded data, scripts that no training text has.

    Each row is judged by its own text: null and repeated ids and repeated rows play no part, the
    language that sorts first wins a tie, an empty table stays empty, columns of any name are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, limit))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, most = shared.value
        for batch in _slices(batches):
            texts = as_bytes(batch.column(at))
            pred, _, rate = _decide(known, texts)
            yield batch.filter(pa.array(
                [p != UNKNOWN and r * len(t) <= MARGIN * most.get(p, 8 / MARGIN) * len(t) + SLACK_BITS for p, r, t in zip(pred, rate, texts, strict=True)], pa.bool_()))

    return docs.mapInArrow(giving_back(run), docs.schema)

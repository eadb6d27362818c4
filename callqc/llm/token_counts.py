"""Token counts through a tokenizer compiled into finite-state transducers.

A byte-level BPE file is compiled into two deterministic transducers:

* the *splitter* reads character classes and marks where a piece (word with its space,
  number, run of marks, white space, contraction) begins.  Text is cut into chunks; the map
  from every state before a chunk to the state after it is found for all chunks at once, the
  maps are composed by a parallel prefix scan, and a last pass marks the pieces from each
  chunk's true state;
* the *counter* reads the bytes of a piece.  Each transition carries the number of tokens it
  adds (or takes back, where bytes merge), so a piece's count is the sum along its path.  All
  pieces run in lock-step.  A state is what later bytes can still depend on: the longest tail
  that begins some token, and the last token and count at every place of that tail.  States
  are compiled when a text first needs them and kept for later texts; the table has a fixed
  size, and pieces that need more states are counted by the library itself, so counts are
  exact whatever the table holds.

A prefix's last token is the one that the prefix before it may be followed by: tokens stand
next to each other in an encoding exactly when the library encodes their joined bytes as that
pair.  The library is asked once per pair; it also tells the class of every character.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callqc.llm.common import arrow_schema, as_bytes

#: Characters that one scan holds (longer texts go through in several windows), and the
#: length of a chunk.
WINDOW, CHUNK = 1 << 20, 128
#: States of the counter that a Python worker keeps; a row of 256 transitions each.
MAX_STATES = 1 << 17

LETTER, NUMBER, MARK, SPACE, WHITE, QUOTE, ONE, R, V, L, E, END, SKIP = range(13)
START, IN_LETTERS, IN_NUMBER, IN_MARKS, SPACE_1, WHITE_1, SPACE_N, WHITE_N, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, SHORT = range(13)
#: What a transition of the splitter emits: a piece begins before the character just read, or
#: before the one ahead of it.
HERE, BEFORE = 1, 2
_QUOTED = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}
_SHORT = {(QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)}  # 're 've 'll


def split_step(state: int, kind: int) -> tuple[int, int]:
    """The splitter's next state and what it emits."""
    if kind == SKIP:
        return state, 0
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if (state, kind) in _SHORT:
            return SHORT, 0
        after, emitted = split_step(IN_LETTERS, kind)  # the quote was a piece of its own
        return after, emitted | BEFORE
    if kind == END:
        return START, 0
    if state == QUOTED and kind == ONE:  # 's 't 'm 'd
        return SHORT, 0
    if state == QUOTED and kind in _QUOTED:
        return _QUOTED[kind], 0
    if kind in (SPACE, WHITE):
        if state in (SPACE_1, WHITE_1, SPACE_N, WHITE_N):
            return (SPACE_N if kind == SPACE else WHITE_N), 0
        return (SPACE_1 if kind == SPACE else WHITE_1), HERE
    run = {NUMBER: IN_NUMBER, MARK: IN_MARKS, QUOTE: IN_MARKS}.get(kind, IN_LETTERS)
    emitted = BEFORE if state in (SPACE_N, WHITE_N) else 0  # the last blank leaves its run
    if state in (SPACE_1, SPACE_N):
        return run, emitted  # and a space joins what follows
    if run == state or (run == IN_MARKS and state == QUOTED):
        return run, 0
    return (QUOTED if kind == QUOTE else run), emitted | HERE


def _tables() -> tuple[np.ndarray, np.ndarray]:
    steps = [[split_step(s, k) for s in range(13)] for k in range(13)]
    return (np.array([[x[0] for x in row] for row in steps], np.uint8).ravel(),
            np.array([[x[1] for x in row] for row in steps], np.uint8).ravel())


NEXT, EMIT = _tables()


def mark_pieces(kinds: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character, from the classes of a text that starts anew."""
    n = len(kinds)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, SKIP, np.uint8)
    grid[:n] = kinds
    rows = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T).astype(np.intp) * 13
    maps = np.broadcast_to(np.arange(13, dtype=np.uint8), (chunks, 13))
    for row in rows:  # the state after the chunk for each state before it
        maps = NEXT[row[:, None] + maps]
    step = 1
    while step < chunks:  # after this, the map from the beginning to each chunk's end
        maps = np.concatenate((maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)))
        step *= 2
    state = np.concatenate(([START], maps[:-1, START])).astype(np.uint8)
    emitted = np.empty((CHUNK, chunks), np.uint8)
    for k, row in enumerate(rows):
        at = row + state
        emitted[k] = EMIT[at]
        state = NEXT[at]
    marks = emitted.T.ravel()[:n]
    begins = (marks & HERE).astype(bool)
    begins[:-1] |= (marks[1:] & BEFORE) != 0
    return begins


def _shape(path: str) -> dict:
    """The file's contents, if it is of the kind compiled here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not any(model.get(k) for k in (
        "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        and not spec.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]))
    if not plain:
        raise ValueError("only byte-level BPE files without normaliser, prefix space or stripping special tokens are compiled")
    return spec


@lru_cache(maxsize=1)
def character_classes(path: str) -> bytes:
    """The class of every code point, as the library's own splitter treats it."""
    from tokenizers import Tokenizer

    _shape(path)
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def kind(c: str) -> int:
        return next((k for before, k in (("a", LETTER), ("1", NUMBER), ("!", MARK)) if len(split(before + c)) == 1), WHITE)

    out = np.full(0x110000, WHITE, np.uint8)
    for c in range(0x100):
        out[c] = kind(chr(c))
    # beyond the space and the quote a piece has characters of one class
    points = [c for c in range(0x100, 0x110000) if not 0xD800 <= c < 0xE000]
    for _, (begin, end) in split("".join(map(chr, points))):
        out[points[begin] : points[end - 1] + 1] = kind(chr(points[begin]))
    for c, k in {" ": SPACE, "'": QUOTE, "s": ONE, "t": ONE, "m": ONE, "d": ONE, "r": R, "v": V, "l": L, "e": E}.items():
        out[ord(c)] = k
    return out.tobytes()


class Counter:
    """Counts of whole texts; one per Python worker."""

    def __init__(self, path: str, classes: bytes, max_states: int = MAX_STATES):
        from tokenizers import Tokenizer

        spec = _shape(path)
        self.model = Tokenizer.from_file(path).model
        self.classes = np.frombuffer(classes, np.uint8)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        # the characters that byte-level files write bytes as
        self.letters = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}
        byte_of = {ord(c): b for b, c in self.letters.items()}
        self.tokens, self.names = {}, {}
        for name, number in spec["model"]["vocab"].items():
            if all(ord(c) in byte_of for c in name):
                self.tokens[bytes(byte_of[ord(c)] for c in name)] = number
                self.names[number] = name
        self.begins = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.max_states = max_states
        # next state * 256 + 128 + tokens added; -1: not compiled.  State 1 is the way out of a full table.
        self.table = np.full(max_states * 256, -1, np.int32)
        self.table[256:512] = 1 * 256 + 128
        self.states: list = [(b"", (-1,), (0,)), None]
        self.number = {self.states[0]: 0}

    def _follows(self, before: int, token: int) -> bool:
        """Whether an encoding may have ``token`` right after ``before`` (-1: at the beginning)."""
        key = before, token
        if key not in self.pairs:
            want = [token] if before < 0 else [before, token]
            got = self.model.tokenize("".join(self.names[t] for t in want))
            self.pairs[key] = [t.id for t in got] == want
        return self.pairs[key]

    def _compile(self, state: int, byte: int) -> None:
        tail, last, counts = self.states[state]
        longer, cut = tail + bytes((byte,)), 0
        while longer[cut:] not in self.begins:
            cut += 1
        fits = []
        for at in range(cut, len(longer)):
            token = self.tokens.get(longer[at:])
            if token is not None and self._follows(last[at], token):
                fits.append((at, token))
        to = 1
        added = 0
        if len(fits) == 1:
            (at, token), = fits
            added = counts[at] + 1
            new = longer[cut:], (*last[cut:], token), (*(c - added for c in counts[cut:]), 0)
            to = self.number.get(new, 1)
            if to == 1 and len(self.states) < self.max_states:
                to = self.number[new] = len(self.states)
                self.states.append(new)
        self.table[state * 256 + byte] = to * 256 + 128 + (added if to != 1 else 0)

    def count_pieces(self, data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of the pieces ``data[first : first + length]``."""
        order = np.argsort(-length, kind="stable")
        at, sizes = first[order], length[order]
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")  # longer than k
        state = np.zeros(len(at), np.int64)
        count = np.zeros(len(at), np.int64)
        for k, n in enumerate(live.tolist()):
            key = state[:n] * 256 + data[at[:n] + k]
            after = self.table[key]
            if (after < 0).any():
                for new in np.unique(key[after < 0]).tolist():
                    self._compile(*divmod(new, 256))
                after = self.table[key]
            count[:n] += (after & 255) - 128
            state[:n] = after >> 8
            if n < 64 and (state[:n] == 1).all():
                break
        for i in np.flatnonzero(state == 1).tolist():  # the table is full
            piece = data[at[i] : at[i] + sizes[i]].tobytes()
            count[i] = len(self.model.tokenize("".join(map(self.letters.__getitem__, piece))))
        out = np.empty(len(at), np.int64)
        out[order] = count
        return out

    def _window(self, parts: list[tuple[int, str]], out: np.ndarray, complete: bool = True) -> int:
        """Add the tokens of texts ``(document, text)`` to ``out``.  Where the last text is not
        ``complete``, its last piece and the blanks around it are left; the number of characters read of it comes back."""
        sizes = np.array([len(t) for _, t in parts])
        text = "\0".join(t for _, t in parts) + "\0"
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes + 1) - 1
        kinds = self.classes[points]
        kinds[ends] = END
        if not complete:  # what the end of the text would emit is not known yet
            kinds[-1] = SKIP
        begins = mark_pieces(kinds)
        begins[ends] = True  # stops the last piece of each text
        read = int(sizes[-1])
        starts = np.flatnonzero(begins)
        if not complete:
            read = int(starts[-2] - (ends[-1] - sizes[-1])) if len(starts) > 1 else 0
            starts = starts[:-1]
        offsets = np.concatenate(([0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000))))
        data = np.frombuffer(text.encode(), np.uint8)
        stop = offsets[starts[1:]]
        starts = starts[:-1]
        text_of = np.searchsorted(ends, starts, "left")
        used = starts != ends[text_of]
        first = offsets[starts[used]]
        counts = self.count_pieces(data, first, stop[used] - first)
        np.add.at(out, np.array([d for d, _ in parts])[text_of[used]], counts)
        return read

    def count(self, texts: list[bytes | None]) -> np.ndarray:
        """Tokens of every text (null: none)."""
        out = np.zeros(len(texts), np.int64)
        parts: list[tuple[int, str]] = []
        held = 0
        for k, raw in enumerate(texts):
            text = (raw or b"").decode("utf-8", "replace")
            between = self.special.split(text) if self.special else [text]
            out[k] += len(between) - 1
            for part in between:
                size = WINDOW
                while len(part) > size:
                    read = self._window([(k, part[:size])], out, complete=False)
                    part, size = part[read:], size if read else size * 2
                if part:
                    parts.append((k, part))
                    held += len(part)
            if held >= WINDOW:
                self._window(parts, out)
                parts, held = [], 0
        if parts:
            self._window(parts, out)
        return out


@lru_cache(maxsize=1)
def counter(path: str, classes: bytes) -> Counter:
    """One counter per Python worker: what it has compiled serves later tasks too."""
    return Counter(path, classes)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, n_bytes, n_tokens`` of every row: UTF-8 bytes, and tokens as the library counts them
    (special strings inside texts are special tokens, nothing is added, cut or padded).

    ``path`` is a ``tokenizers`` file that every executor can read.  Null and empty texts have
    no tokens; rows are independent, so null and repeated ids and repeated rows keep a row each;
    an empty table gives no rows; other columns are not read, so their names cannot clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(character_classes(path))  # a byte per code point
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_tokens long"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, shared.value)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            sizes = pa.array([len(t or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(out.field(0).type), sizes, pa.array(own.count(texts), pa.int64())], schema=out)

    used = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return used.mapInArrow(run, schema).withColumnRenamed("id", id_col)

"""Chat formatting: turns assembled into one preallocated buffer per batch.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``.  Control strings of this and other
templates that occur inside a role or text are escaped by a backslash after their first
character, and a backslash is doubled, so the formatted text can be read back exactly and
a user cannot write a turn of their own.  The loss mask covers the (escaped) texts of the
assistant.

Rows are range partitioned and sorted by conversation and turn, so a conversation of any
length is spread over tasks (the sampled range keys hold the beginning of a text only); the output has one row for each conversation and task, in
the order of ``piece``, and the pieces of a conversation joined are its formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of chat templates that are escaped inside texts.
CONTROL = (START, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|system|>",
           "<|user|>", "<|assistant|>")
LOSS_ROLE = "assistant"
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.S)


def escape(text: pa.Array) -> pa.Array:
    """Backslashes doubled, then one put into every control string (Arrow strings)."""
    text = pc.replace_substring(text, "\\", "\\\\")
    for control in CONTROL:
        text = pc.replace_substring(text, control, control[0] + "\\" + control[1:])
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow large_string array."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data, offsets


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of all turns in one buffer, row offsets, and begin and end of each text.

    The five segments of each row (three constant ones, role and text) have their lengths
    summed into offsets; each column is then scattered to its places in the buffer.
    """
    n = len(roles)
    roles = escape(roles.cast(pa.large_string()).fill_null(""))
    texts = escape(texts.cast(pa.large_string()).fill_null(""))
    columns: list[tuple[np.ndarray, np.ndarray]] = []
    for part in (START, roles, SEP, texts, END):
        if isinstance(part, str):
            data = np.frombuffer(part.encode(), np.uint8)
            columns.append((np.tile(data, n), np.arange(n + 1) * len(data)))
        else:
            data, offsets = _buffer(part)
            columns.append((data[offsets[0] : offsets[-1]], offsets - offsets[0]))
    lengths = np.stack([np.diff(offsets) for _, offsets in columns], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(n, len(columns))
    begins = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, (data, offsets) in enumerate(columns):
        # byte b of row r goes to begins[r] + (b - offsets[r])
        out[np.arange(len(data)) + np.repeat(begins[:, k] - offsets[:-1], lengths[:, k])] = data
    rows = np.concatenate((begins[:, 0], ends[-1:, -1])) if n else np.zeros(1, np.int64)
    return out, rows, begins[:, 3], ends[:, 3]


#: Characters of role and text that are part of the sampled range keys (the sort goes by all).
KEY_CHARS = 64
SCHEMA = "conv_id {kind}, piece long, n_turns long, formatted string, loss array<struct<begin:bigint,end:bigint>>"


def format_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Formatted conversations: ``conv_id, piece, n_turns, formatted, loss``.

    ``loss`` holds the byte spans of the piece that are trained on.  Turns go by ``turn``;
    turns that repeat it go by role and text, and repeated rows all stay.  Null roles and
    texts count as empty, null turn numbers go first, and rows of a null conversation id are
    one conversation.  An empty table gives an empty result; other columns are not read.
    """
    used = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = used.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out, rows, begin, end = assemble(batch.column(2), batch.column(3))
            ids = batch.column(0)
            # pieces: runs of one conversation within the batch (its rows are sorted)
            codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1, [batch.num_rows]))
            formatted = pa.Array.from_buffers(
                pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(rows[cuts].astype(np.int64)), pa.py_buffer(out)])
            trained = pc.equal(batch.column(2).cast(pa.string()), LOSS_ROLE).to_numpy(zero_copy_only=False).astype(bool)
            base = np.repeat(rows[cuts[:-1]], np.diff(cuts))
            b, e = (begin - base)[trained], (end - base)[trained]
            counts = np.concatenate(([0], np.cumsum(trained)))[cuts]
            loss = pa.ListArray.from_arrays(pa.array(counts, pa.int32()),
                                            pa.StructArray.from_arrays([pa.array(b), pa.array(e)], ["begin", "end"]))
            piece = (task << 32) + at + np.arange(len(cuts) - 1)
            at += len(cuts) - 1
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(cuts[:-1])), pa.array(piece, pa.int64()), pa.array(np.diff(cuts), pa.int64()),
                 formatted.cast(pa.string()), loss], ["conv_id", "piece", "n_turns", "formatted", "loss"])

    # beginnings follow the order of the whole strings, so the ranges keep it
    bounds = ["conv_id", "turn", *(F.substring(c, 1, KEY_CHARS) for c in ("role", "text"))]
    return used.repartitionByRange(*bounds).sortWithinPartitions(*order).mapInArrow(run, SCHEMA.format(kind=kind))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, from its formatted pieces and loss spans alone.

    The pieces of a conversation are streamed in order through one digest, so a very long
    conversation needs the memory of one piece.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None  # conv_id, turns, digest, loss chars, loss digest, chars
        done: list[list] = []

        def close() -> None:
            if state is not None:
                done.append([state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]])

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                                              ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            types[0] = batch.schema.field(0).type
            for conv, text, loss in zip(batch.column(0).to_pylist(), as_text(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in parse(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{content}\n".encode())
                raw = text.encode()
                for span in loss or ():
                    content = unescape(raw[span["begin"] : span["end"]].decode())
                    state[3] += len(content)
                    state[4].update(content.encode())
                state[5] += len(text)
            if len(done) >= 4096:
                yield out()
                done.clear()
        close()
        if done:
            yield out()

    return (formatted.select("conv_id", "piece", "formatted", "loss").repartition("conv_id")
            .sortWithinPartitions("conv_id", "piece").select("conv_id", "formatted", "loss")
            .mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))


def as_text(column: pa.Array) -> list[str]:
    return column.cast(pa.large_string()).to_pylist()

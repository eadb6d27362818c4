"""Token-ID output: documents as separately compressed frames with a shared dictionary.

A store is a folder of Parquet files written and committed by Spark:

* ``dictionary``: one row with the zstandard dictionary, its hash, and the width of an id;
* ``blocks``: one row per block of documents in ascending id order: the frames of its
  documents one after the other, where each begins (the offset index), the ids and token
  counts of the documents, the place of the block (``shard, block``), the tokens before it
  within its shard, and the hash of the dictionary its frames need.

A frame is the little-endian id array of one document, compressed alone, so a document is
read by decompressing one frame.  Blocks are bounded, so no task holds more than one, and a
lost task writes its shard again.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callqc.llm.common import arrow_schema, giving_back, short_table

END_ID = 2
#: Documents that the dictionary is trained on (about so many, by a hash of the id; whole
#: texts), and its size in bytes.  The only bounded sample here.
SAMPLE_DOCS, DICTIONARY_BYTES = 400, 64 << 10
LEVEL = 3
#: Tokens after which a block is full.
BLOCK_TOKENS = 1 << 20
#: Pieces, and odd words, whose ids a worker remembers in each of two generations.
REMEMBER = 250_000
#: Bytes of text whose words are looked up together.
SLICE = 6 << 20

#: Small letters of Latin-1, and ASCII marks but the quote that may begin a contraction.
_LATIN, _MARKS = re.compile("[a-zß-öø-ÿ]+"), "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The normaliser and splitter of files whose texts can be encoded word by word.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def _byte_letters() -> list[str]:
    """The characters that byte-level vocabularies write bytes as: printable ones as themselves,
    the others in order from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Recent:
    """Values of the keys asked for of late.  A full generation becomes the old one, whose keys are
    taken over when asked for again, so what is frequent is made once."""

    def __init__(self, make: Callable[[list], Iterator]):
        self.make, self.young, self.old = make, {}, {}

    def __call__(self, keys: set) -> dict:
        """A dictionary that holds the keys (values of others may go with the next call)."""
        if len(self.young) > REMEMBER:
            self.young, self.old = {}, self.young
        new = keys.difference(self.young)
        again = new.intersection(self.old)
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        new = list(new.difference(again))
        self.young.update(zip(new, self.make(new), strict=True))
        return self.young


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file.

    With a file of the rules ``_BY_WORD``, no piece spans white space: words (between ASCII white
    space) are split into letters and the marks behind them.  Latin-1 letters and ASCII marks are the
    pieces that the library would make; they go to its model as such and are remembered.  All other
    words go through the whole tokenizer, and so do whole texts with any other file.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and all(spec.get(k) == v for k, v in _BY_WORD.items())
        # special tokens are whole words at most where white space parts them from nothing
        self.by_word &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search("\\s", t["content"]) for t in spec["added_tokens"])
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.model, letters = self.tokenizer.model, _byte_letters()
        self.table = {b: letters[b] for b in range(256)}
        self.code = {k: k.to_bytes(self.width, "little") for k in self.tokenizer.get_vocab(with_added_tokens=True).values()}
        # what small letters might turn into a special token
        self.special = "(?i)" + "|".join(re.escape(t["content"]) for t in spec["added_tokens"]) if spec["added_tokens"] else None
        self.pieces, self.odd = Recent(self._pieces), Recent(lambda words: map(self._whole, words))

    def _pieces(self, pieces: list[bytes]) -> Iterator[bytes | None]:
        """Ids of letters or of marks; None for what is neither."""
        marks = _MARKS.encode()
        for p in pieces:
            if p.isalpha():  # ASCII
                text = p.lower().decode()
            elif p.isascii():
                text = None if p.strip(marks) else p.decode()
            else:
                text = p.decode("utf-8", "replace")
                small = text.lower()
                text = small.encode().decode("latin-1").translate(self.table) if len(small) == len(text) and _LATIN.fullmatch(small) else None
            yield None if text is None else b"".join([self.code[t.id] for t in self.model.tokenize(text)])

    def _whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, f"<u{self.width}").tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of every text of a binary column as little-endian integers of ``width`` bytes."""
        if not self.by_word:
            yield from (self._whole(t or b"") for t in texts.to_pylist())
            return
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        begin = 0
        while begin < len(texts):
            held = int(ends[begin - 1]) if begin else 0
            stop = max(int(np.searchsorted(ends, held + SLICE, "right")), begin + 1)
            first, word, ids = self._slice(texts.slice(begin, stop - begin))
            pa.default_memory_pool().release_unused()  # the words of a slice take many times its bytes
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                yield b"".join(ids[word[a:b]].tolist())
            del first, word, ids
            begin = stop

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of each text's first word, and of the end; each word's number; the ids of the words
        of each number.  Each different piece is looked up once."""
        texts = pa.Array.from_buffers(pa.large_string(), len(texts), texts.buffers(), offset=texts.offset)  # ASCII functions read bytes
        small = pc.ascii_lower(texts)
        if self.special:
            small = pc.if_else(pc.match_substring_regex(small, self.special), texts, small)
        words = pc.ascii_split_whitespace(small)
        first, coded = words.offsets.to_numpy(), words.values.dictionary_encode()
        different = coded.dictionary
        # the marks behind a word are pieces of their own
        letters = pc.ascii_rtrim(different, characters=_MARKS)
        behind = pc.subtract(pc.binary_length(different), pc.binary_length(letters)).to_numpy()
        letters = letters.dictionary_encode()
        begin = letters.dictionary.cast(pa.large_binary()).to_pylist()
        marked = np.flatnonzero(behind)
        ends = [w[len(w) - n :] for w, n in zip(different.take(pa.array(marked)).cast(pa.large_binary()).to_pylist(), behind[marked].tolist(), strict=True)]
        known = self.pieces({*begin, *ends})
        plain = np.empty(len(begin), object)
        plain[:] = [known[x] for x in begin]
        ids = plain[letters.indices.to_numpy()]
        odd = np.flatnonzero(np.equal(ids, None))
        ids[marked] = [(a or b"") + known[m] for a, m in zip(ids[marked].tolist(), ends, strict=True)]
        whole = different.take(pa.array(odd)).cast(pa.large_binary()).to_pylist()
        by_library = self.odd({*whole})
        ids[odd] = [by_library[w] for w in whole]
        return first, coded.indices.to_numpy(), ids


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per Python worker, so that the words it knows serve later tasks too."""
    return WordEncoder(path)


def train_dictionary(docs: DataFrame, id_col: str, text_col: str, encoder: Callable[[], WordEncoder], sample_docs: int) -> bytes:
    """A dictionary from the id arrays of about ``sample_docs`` documents; empty if they are too few."""
    used = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    n = used.count()
    drawn = F.coalesce(F.pmod(F.xxhash64("id", F.lit("dictionary")), F.lit(1 << 30)), F.lit(0)) / F.lit(float(1 << 30))
    sample = used.where(drawn < F.lit(sample_docs / max(n, 1))).select(F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(encoder().encode(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    samples = sorted(x for x in sample.mapInArrow(giving_back(run), "ids binary").toArrow()["ids"].to_pylist() if x)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short: their own bytes serve
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def dictionary_hash(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


BLOCKS = ("shard int, block int, first_id {kind}, last_id {kind}, before long, n_tokens long, doc_ids array<{kind}>, "
          "doc_tokens array<int>, offsets array<long>, frames binary, dictionary_hash string")


def write(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
    sample_docs: int = SAMPLE_DOCS,
) -> None:
    """Write the documents of a table to a store at ``path`` in ascending id order.

    Null and empty texts have the end id alone.  Null ids come first, and rows that repeat an
    id follow each other by text; every row is a document.  An empty table makes a store
    without blocks.  Other columns are not read.
    """
    spark = docs.sparkSession

    def encoder() -> WordEncoder:
        return word_encoder(tokenizer)

    data = train_dictionary(docs, id_col, text_col, encoder, sample_docs)
    width, key = encoder().width, dictionary_hash(data)
    short_table(spark, [(data, key, width)], "dictionary binary, hash string, width int").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(data)
    used = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = used.schema["id"].dataType.simpleString()
    schema = BLOCKS.format(kind=kind)
    out_schema = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        known = _dictionary(shared.value)
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True).compress
        own, end = encoder(), np.array([end_id], f"<u{width}").tobytes()
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def full() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).tolist()
            row = (shard, block, ids[0], ids[-1], before, held, ids, counts, offsets, b"".join(frames), key)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out_schema, strict=True)], schema=out_schema)

        for batch in batches:
            for doc, encoded in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                tokens = encoded + end
                ids.append(doc)
                counts.append(len(tokens) // width)
                frames.append(compress(tokens))
                held += counts[-1]
                if held >= BLOCK_TOKENS:
                    yield full()
                    block, before, held = block + 1, before + held, 0
                    ids, counts, frames = [], [], []
        if ids:
            yield full()

    (used.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(giving_back(run), schema)
     .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


class Store:
    """A written store, read through Spark."""

    def __init__(self, spark: SparkSession, path: str):
        row = spark.read.parquet(f"{path}/dictionary").first()
        if dictionary_hash(bytes(row["dictionary"])) != row["hash"]:
            raise ValueError("the dictionary does not have its hash")
        self.spark, self.width, self.hash = spark, row["width"], row["hash"]
        self.dictionary = spark.sparkContext.broadcast(bytes(row["dictionary"]))
        self.blocks = spark.read.parquet(f"{path}/blocks")

    def starts(self) -> DataFrame:
        """Tokens of all shards before each shard; a row per shard (a task of the writer)."""
        totals = self.blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
        return totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def _frames(self, blocks: DataFrame, wanted: frozenset | None, schema: str, result: Callable[..., Sequence]) -> DataFrame:
        """``result(id, start, ids)`` for every document of the blocks, or of ``wanted`` alone."""
        dictionary, width, key, out_schema = self.dictionary, self.width, self.hash, arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _dictionary(dictionary.value)
            open_frame = zstandard.ZstdDecompressor(dict_data=known).decompress
            for batch in batches:
                for r in range(batch.num_rows):
                    start, ids, counts, offsets, hash_ = (batch.column(c)[r].as_py() for c in (0, 1, 2, 3, 5))
                    if hash_ != key:
                        raise ValueError("a block needs another dictionary")
                    frames = memoryview(batch.column(4)[r].as_buffer())
                    rows = []
                    for k, (doc, n) in enumerate(zip(ids, counts, strict=True)):
                        if wanted is None or doc in wanted:
                            rows.append(result(doc, start, np.frombuffer(open_frame(frames[offsets[k] : offsets[k + 1]]), f"<u{width}")))
                        start += n
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), out_schema, strict=True)], schema=out_schema)

        # the bases are one row per shard
        placed = blocks.join(F.broadcast(self.starts()), "shard")
        return placed.select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "doc_tokens", "offsets", "frames",
                             "dictionary_hash").mapInArrow(giving_back(run), schema)

    def digests(self) -> DataFrame:
        """``doc_id, start, n_tokens, ids_crc32`` of every document, from its decompressed frame."""
        kind = self.blocks.schema["first_id"].dataType.simpleString()
        return self._frames(self.blocks, None, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long",
                            lambda doc, start, ids: (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))

    def documents(self, wanted: Sequence) -> DataFrame:
        """``doc_id, start, ids`` of a short list of documents: only blocks that hold them are read,
        and only their frames are decompressed."""
        kind = self.blocks.schema["first_id"].dataType.simpleString()
        held = F.lit(False)
        for doc in wanted:
            # null ids come first, so a block may begin without an id
            held |= F.coalesce(F.col("first_id") <= F.lit(doc), F.lit(True)) & (F.col("last_id") >= F.lit(doc))
        return self._frames(self.blocks.where(held), frozenset(wanted), f"doc_id {kind}, start long, ids array<long>",
                            lambda doc, start, ids: (doc, start, ids.tolist()))

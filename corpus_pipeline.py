"""Corpus pipeline: the stages from raw documents to token output.

``run(spark, sf_dir)`` applies ``STAGES`` to the documents of a folder; every stage gets
what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callqc.llm import decontam, langid, mixing, simhash, token_store
from callqc.llm.common import free_name, new_folder, temporary_tables, with_rows, word_count, written

#: Bytes of an Arrow batch.  Spark and its Python workers hold several whole batches each, and what
#: their allocators keep of freed ones grows with the batch; 64 MB, Spark's default, is a task's whole share.
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """``stage`` with the session's Arrow batches bounded.

    The setting stays, as the batches are made when the caller writes the result.
    """

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents teach; the rest is rejected:
    null texts, texts without a letter, and texts that cost far more bits than their language does.

    Rows are judged by their own text, so null or repeated ids and repeated rows play no part; a
    tie goes to the language that sorts first; an empty table stays empty; further columns, of any
    name, are kept.
    """
    model = langid.train(docs)
    return langid.keep_known(docs, model, langid.limits(docs, model))


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the smallest id, rows without an id last.

    Rows that share an id but not their text are different documents; of repeated rows one stays;
    null and empty texts are copies of each other; an empty table stays empty; further columns, of
    any name, are kept.
    """
    return simhash.keep_one(docs)


@in_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Rows are judged by their own text: null or repeated ids play no part, repeated rows stay or go
    together, null and empty texts stay, any one item suffices, so nothing ties; an empty table
    stays empty; further columns, of any name, are kept.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it (a row each), so not at all if it is not taken.

    Each row is a document of its own, whether its id is null, repeated or unique; equal hashes (copies
    of one id and text) take whichever of them; texts without words are never taken; an empty
    table stays empty; further columns, of any name, are kept.
    """
    rows, row = with_rows(docs, "mixture")
    mixed, _ = mixing.mix(rows, F.array("source"), word_count(F.col("text")), content=F.xxhash64("text"), row=F.col(row))
    times, copy = free_name(rows, "times"), free_name(rows, "copy")
    wanted = mixed.where("taken > 0").select(F.col("row").alias(row), F.expr("taken div size").cast("int").alias(times))
    joined = rows.join(wanted, row)
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), times)).alias(copy)).drop(copy)


@in_small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents: id, place of the first token, number of tokens and checksum.

    Every row is a document: null ids come first, rows of one id follow each other by text, null and
    empty texts have the end id alone, an empty table makes an empty store, further columns are
    not read.
    """
    path = new_folder(spark, "tokens")
    token_store.write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.Store(spark, path).digests()


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixture", mixture), ("tokens", tokens)]

#: Models, components and tilings are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *inner, (_, last) = STAGES
    before: list[str] = []
    for name, stage in inner:
        with temporary_tables(spark) as made:  # a stage's own tables are not needed once its result is written
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            result = made.pop()
            made.extend(before)  # nor is what it read
        before = [result]
    return last(spark, docs, sf_dir)

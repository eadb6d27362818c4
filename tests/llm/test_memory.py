"""What the steps leave in an executor: freed Arrow memory, sets of Python workers, sizes of batches."""

import subprocess
import sys

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from callqc.llm import langid, mixing, token_store
from callqc.llm.common import giving_back, new_folder, short_table

LEFT = """
import re, sys
import pyarrow as pa
from callqc.llm.common import giving_back

def anonymous():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\\s+(\\d+)", f.read())[1]) / 1024

def run(batches):
    for batch in batches:
        held = [pa.array([b"x" * 3000] * 1000) for _ in range(60)]
        del held
        yield batch

before = anonymous()
for _ in giving_back(run)(iter([pa.RecordBatch.from_pydict({"a": [1]})] * 3)):
    pass
print(anonymous() - before)
"""


def test_freed_arrow_memory_goes_back():
    left = float(subprocess.run([sys.executable, "-c", LEFT], capture_output=True, text=True, check=True).stdout)
    assert left < 60  # MB, of 180 that a batch takes


def test_batches_are_given_on_and_errors_raised():
    def run(batches):
        for batch in batches:
            yield batch.slice(0, 1)
        raise ValueError("end")

    batches = giving_back(run)(iter([pa.RecordBatch.from_pydict({"a": [k, k]}) for k in range(3)]))
    assert [next(batches).to_pydict() for _ in range(3)] == [{"a": [k]} for k in range(3)]
    with pytest.raises(ValueError, match="end"):
        next(batches)


def test_short_tables_need_no_plain_python_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "s", "a b c"), (2, None, "d e"), (3, "t", "")], "doc_id long, source string, text string")

    def refuse(*_, **__):
        raise AssertionError("rows of Python objects")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    mixed, _ = mixing.mix(docs, F.array("source"), F.length("text"))
    assert mixed.count() == 3
    path = new_folder(spark, "test-store")
    token_store.write(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    assert token_store.Store(spark, path).digests().count() == 3
    kinds = "a int, b array<string>, c binary"
    assert short_table(spark, [], kinds).collect() == []
    rows = [(1, ["x", None], b"\0"), (None, None, None)]
    assert [tuple(r) for r in short_table(spark, rows, kinds).collect()] == rows


def test_stages_bound_the_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word', id, ' '), 800)").alias("text"),
                                           F.lit("en").alias("lang"), F.lit("s").alias("source"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        corpus_pipeline.language(spark, docs, "")
        found = docs.mapInArrow(sizes, "n long").agg(F.max("n"), F.count("*")).first()
        assert found[0] < 2 * corpus_pipeline.BATCH_BYTES and found[1] > 3
    finally:
        spark.conf.set(name, before)
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)


def test_counts_do_not_depend_on_the_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(k, ("de", "en")[k % 2], f"Wort {k % 7} und word {k}" * (k % 3)) for k in range(60)],
                                 "doc_id long, lang string, text string").coalesce(1)
    whole, before = langid.train(docs), spark.conf.get(name)
    try:
        spark.conf.set(name, "4")
        parts = langid.train(docs)
    finally:
        spark.conf.set(name, before)
    assert whole.languages == parts.languages
    assert all(np.array_equal(getattr(whole, k), getattr(parts, k)) for k in ("context", "escape", "grams", "cost"))

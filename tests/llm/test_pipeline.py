"""The pipeline: every stage against brute force on its own input, and run() against the stages."""

import os
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from callqc.llm import decontam, langid, mixing
from callqc.plans.stored import shared_folder
from tokenizers import Tokenizer

from .test_simhash import components, reference


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf_dir)
        path = str(tmp_path_factory.mktemp(name) / "out")
        after.write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_columns(stages, spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    assert all(after.schema == own for _, after in stages[:-1])


def test_language_rejects_noise_and_keeps_texts(stages, spark, sf_dir):
    before, after = stages[0]
    texts = {r.doc_id: r.text for r in before.collect()}
    kept = {r.doc_id for r in after.collect()}
    with_letters = {d for d, t in texts.items() if t and langid.has_letter(t.encode())}
    assert kept <= with_letters and len(with_letters - kept) <= len(texts) // 200
    rng = random.Random(3)
    noise = {10_000_000 + k: "".join(rng.choice("qwrtzpsdfghjklyxcvbnmQXZKJ0123456789 ") for _ in range(200 + 40 * k)) for k in range(40)}
    own = before.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(d, t, None) for d, t in noise.items()], "doc_id long, text string, lang string"))
    again = {r.doc_id for r in corpus_pipeline.language(spark, own, sf_dir).collect()}
    assert again == kept  # all noise goes, and nothing else


CLASHING = ("_best", "_items", "_kept", "_key", "_text", "_time", "_times", "doc", "row", "ROW_", "copy", "times", "best", "covering", "fp", "component", "component_id",
            "pattern", "hash", "salt", "taken", "members", "key", "whole_text", "id", "bits_per_byte", "size")


@pytest.mark.parametrize("blocks", [1, 3])
def test_no_row_is_lost_and_no_name_clashes(spark, sf_dir, monkeypatch, blocks):
    """Three rows without an id, one id with two texts, one row twice; columns of any name."""
    long = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en' AND octet_length(text) > 900").limit(6).collect()
    texts = [r.text for r in long]
    ids = [None, None, None, 5, 5, 6]
    rows = [(i, t, "en", "s", len(t), *range(len(CLASHING))) for i, t in zip(ids, texts, strict=True)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)
    docs = spark.createDataFrame([*rows, rows[-1]], schema)
    if blocks > 1:
        monkeypatch.setattr(decontam.clean, "__defaults__", (*decontam.clean.__defaults__[:-1], 2000))
    for (name, stage), left in zip(corpus_pipeline.STAGES[:4], (7, 6, 7, 7), strict=True):
        if name == "language":
            continue  # its model is trained on more texts below
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns and sorted(r.text for r in got.collect()) == sorted(texts if left == 6 else [*texts, texts[-1]]), name
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert langid.keep_known(docs, model, {}).count() == 7


def test_near_duplicates_keep_the_smallest_id(stages):
    before, after = (f.collect() for f in stages[1])
    want = components([(r.doc_id, reference(r.text)) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(set(want.values()))
    assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()


def test_decontamination(stages, tables):
    before, after = (f.collect() for f in stages[2])
    items = [decontam.words_of(t.encode()) for _, t in tables.sql("SELECT item_id, text FROM benchmark").fetchall()]
    kept = {r.doc_id for r in after}
    for r in before:
        text = b" " + b" ".join(decontam.words_of(r.text.encode())) + b" "
        leaked = any(b" " + b" ".join(w) + b" " in text for w in items)
        assert (r.doc_id not in kept) == leaked


def test_mixture(stages):
    before, after = (f.collect() for f in stages[3])
    size = {r.doc_id: len(r.text.encode().split()) for r in before}
    words, taken = {}, {}
    for r in before:
        words[r.source] = words.get(r.source, 0) + size[r.doc_id]
    times = {}
    for r in after:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
    names = sorted(words, key=lambda s: (s is None, s or ""))
    want = mixing.targets([words[s] for s in names], [k % 3 + 1 for k in range(len(names))])
    assert max(times.values()) <= 3
    assert all(abs(taken.get(s, 0) - t) <= max(20, 0.01 * t) for s, t in zip(names, want, strict=True))


def test_tokens(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, after = (f.collect() for f in stages[4])
    start, want = 0, []
    for r in sorted(before, key=lambda r: (r.doc_id, r.text)):
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, after)) == want


def test_run_equals_the_stages(stages, spark, sf_dir):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, sf_dir)
    # what the stages left behind: the last one's input, its tokens, and nothing else
    assert {f.rsplit("-", 1)[0] for f in set(os.listdir(folder)) - before} == {"stage-mixture", "tokens"}
    assert got.columns == stages[-1][1].columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_empty_and_odd_documents(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a the of", "en", None, 8), (3, "a the of", "en", None, 8), (4, "der die " * 50_000, "de", "t", 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.count()


def test_names_do_not_leak_from_other_modules():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixture", "tokens"]
    assert not re.search("except", open(corpus_pipeline.__file__).read())

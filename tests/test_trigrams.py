"""Substring search through the trigram index, and payloads in pieces."""

import os

import pytest
from pyspark.sql import functions as F

from callqc.operators import conversations
from callqc.sources import sinks, tables, trigrams
from callqc.sources.fixtures import fixture_tables
from tests.helpers import call
from tests.helpers import tables as hand_made

SF = "/root/testdata/sf0.001"


def test_literal_runs():
    assert trigrams.literal_runs(r" a%b_c\%d\\e ") == ["a", "b", r"c%d\e"]
    assert trigrams.trigrams("AbcD%xy_z") == {"abc", "bcd"} and trigrams.trigrams("%%") == set()


@pytest.mark.parametrize("search", ["CALL00000042", "0042", "call%42", "00_42", "l0000004", "zzz", "0000099", "9", "42%", r"100\%", r"A\_B", "İst"])
def test_index_and_scan_find_the_same(spark, tmp_path, search):
    base = fixture_tables(spark, SF)
    odd = [call(10_000 + k, "2024-01-03 10:00:00", unique_id=u, is_analyzed=False) for k, u in enumerate(["100%", "A_B", "AxB", "ab", "", None, "istanbul", "İSTANBUL", "a\\b"])]
    log = base.conversations_log.unionByName(hand_made(spark, odd).conversations_log.drop("conversation_data", "silence_timeline"), allowMissingColumns=True)
    t = base.with_(conversations_log=log)
    trigrams.write_index(log, str(tmp_path / "index"))
    indexed = t.with_(call_index=trigrams.TrigramIndex.load(spark, str(tmp_path / "index")))
    for make in (conversations.unanalyzed_page, conversations.analyzed_page_info):
        assert make(indexed, unique_id=search).collect() == make(t, unique_id=search).collect()


def test_only_the_days_found_are_read(spark, tmp_path):
    base, t = str(tmp_path / "qc"), fixture_tables(spark, SF)
    sinks.write_tables(t, base)
    trigrams.write_index(t.calls, str(tmp_path / "index"))
    stored = tables.load_parquet(spark, base).with_(call_index=trigrams.TrigramIndex.load(spark, str(tmp_path / "index")))
    target = t.calls.where("NOT is_analyzed").orderBy(F.col("id").desc()).first()
    want = conversations.unanalyzed_page(t, unique_id=target.unique_id[-6:]).collect()
    days = {r[0] for r in t.calls.where(F.col("unique_id").contains(target.unique_id[-6:])).select(F.to_date("created_at").cast("string")).collect()}
    for day in os.listdir(f"{base}/conversations_log"):
        if day.startswith("created_date=") and day.removeprefix("created_date=") not in days:
            for name in os.listdir(f"{base}/conversations_log/{day}"):
                with open(f"{base}/conversations_log/{day}/{name}", "wb") as f:
                    f.write(b"not read")
    df = conversations._backlog(stored, None, target.unique_id[-6:]).select("id")
    assert len(want) and {r.id for r in df.collect()} == {r.id for r in want}


def test_a_call_of_a_million_turns(spark):
    turns = spark.range(1_000_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    more = spark.createDataFrame([(2, 5, "user", "x"), (2, 4, "agent", "y"), (3, 2500, "user", "z")], "conv_id long, turn long, role string, text string")
    t = hand_made(spark, [call(1, "2024-01-01 00:00:00")]).with_(conversation_turns=turns.unionByName(more))
    got = tables.payload_chunks(t).withColumn("n", F.size("turns"))
    assert got.agg(F.count("*"), F.max("n"), F.sum("n")).first()[:3] == (1002, 1000, 1_000_003)
    piece = got.where("call_id = 1 AND chunk = 7").first()
    assert piece.first_turn == 7000 and [x.text for x in piece.turns] == [f"t{k}" for k in range(7000, 8000)]
    assert [tuple(x) for x in got.where("call_id = 2").first().turns] == [(4, "agent", "y"), (5, "user", "x")]
    keys = spark.createDataFrame([(3,)], "call_id long")
    assert [(r.call_id, r.chunk) for r in tables.payload_chunks(t, keys).collect()] == [(3, 2)]
    with pytest.raises(ValueError):
        tables.payload_chunks(t.with_(conversation_turns=None))

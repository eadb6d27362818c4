"""Key look-ups and payload sources."""

import pytest

from callqc.plans import lookup
from callqc.sources.tables import Tables, load_jdbc
from tests.helpers import analysis, call, tables

TL = [{"start": 0.5, "end": 1.0}]


def test_restrict_forms(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "k")
    assert lookup.restrict(df, "k", None).count() == 20000
    assert lookup.restrict(df, "k", 7).count() == 1
    assert lookup.restrict(df, "k", [1, 2, 3, 99999]).count() == 3
    many = list(range(0, 40000, 2))
    assert lookup.restrict(df, "k", many).count() == 10000
    keys = spark.range(5, 10)
    assert sorted(r.k for r in lookup.restrict(df, "k", keys).collect()) == [5, 6, 7, 8, 9]


def test_payloads_from_turn_rows_and_stored_timeline(spark):
    base = tables(spark, [call(1, "2024-01-01 00:00:00", silence_timeline=TL), call(2, "2024-01-02 00:00:00"),
                          call(3, "2024-01-03 00:00:00")],
                  [analysis(11, 1, "2024-01-01 01:00:00")])
    turns = spark.createDataFrame([(1, 1, "agent", "b"), (1, 0, "user", "a"), (3, 0, "user", "c")],
                                  "conv_id long, turn long, role string, text string")
    t = Tables(base.conversations_log.drop("conversation_data"), base.conversation_analysis,
               base.conversation_review_human, base.qc_users, base.qc_settings, conversation_turns=turns)
    got = {r.call_id: ([x.text for x in r.conversation_data] if r.conversation_data else None,
                       [x.end for x in r.silence_timeline] if r.silence_timeline else None)
           for r in t.payloads().collect()}
    assert got[1] == (["a", "b"], [1.0])
    assert got[3] == (["c"], None)
    assert got.get(2, (None, None)) == (None, None)
    keys = spark.createDataFrame([(3,)], "call_id long")
    assert [r.call_id for r in t.payloads(keys).collect()] == [3]


def test_apply_conf_sets_runtime_sql_settings(spark):
    from callqc.session import apply_conf, tuned_conf

    before = spark.conf.get("spark.sql.shuffle.partitions")
    conf = tuned_conf(8)
    apply_conf(spark, conf)
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_jdbc_refuses_fact_tables_read_by_one_task(spark):
    with pytest.raises(ValueError, match="conversation_analysis, conversation_review_human"):
        load_jdbc(spark, "jdbc:none", {}, predicates={"conversations_log": ["id < 5", "id >= 5"]})

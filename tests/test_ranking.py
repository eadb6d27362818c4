"""Distributed row numbering and the page cut equal a single-partition row_number."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from callqc.plans import paging
from callqc.plans.paging import Keys
from callqc.plans.ranking import global_row_number


def numbered(df, order):
    return global_row_number(df, order, F.floor("v"), F.col("_b").desc_nulls_first())


def _want(df, order):
    return {r.k: r.rank for r in df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).collect()}


def test_global_row_number_matches_brute_force(spark):
    random.seed(7)
    rows = [(f"a{i:04d}", random.choice([None, 1.0, 2.5, 2.25, 3.0, 7.25])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(13)
    order = [F.col("v").desc_nulls_first(), F.col("k").asc_nulls_last()]
    got = numbered(df, order)
    assert dict(got.dtypes)["rank"] == "bigint"
    ranks = {r.k: r.rank for r in got.collect()}
    assert ranks == _want(df, order) and sorted(ranks.values()) == list(range(1, 3001))


def test_global_row_number_empty_and_single(spark):
    order = [F.col("v").desc_nulls_first(), F.col("k")]
    empty = spark.createDataFrame([], "k string, v double")
    assert numbered(empty, order).count() == 0
    one = spark.createDataFrame([("x", None)], "k string, v double")
    assert [r.rank for r in numbered(one, order).collect()] == [1]


def order():
    return [F.col("at").desc_nulls_first(), F.col("k").asc_nulls_last()]


def listing(df, spans=None):
    def source(span):
        if spans is not None:
            spans.append(span)
        return df if span is None else span.of(df, "at")

    return Keys(source, "at", "k", order())


def test_cut_equals_a_sorted_slice(spark):
    random.seed(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, random.choice([None, start + dt.timedelta(minutes=random.randrange(60 * 72))])) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz").repartition(5)
    every = [r.k for r in df.orderBy(*order()).collect()]
    for offset, limit in ((0, 1), (0, 40), (230, 50), (499, 10), (500, 10), (0, 500), (3_000_000_000, 5)):
        assert [r.k for r in listing(df).cut(offset, limit).collect()] == every[offset : offset + limit]


@pytest.mark.parametrize("text_keys", [False, True])
def test_a_hot_hour_is_split(spark, monkeypatch, text_keys):
    """A third of the rows at one time, a third within one second, many without a time."""
    monkeypatch.setattr(paging, "MAX_SORT", 60)
    monkeypatch.setattr(paging, "SPLITS", 8)
    random.seed(5)
    hot = dt.datetime(2024, 1, 2, 3, 4, 5, 678)
    times = [hot] * 700 + [hot + dt.timedelta(microseconds=random.randrange(900_000)) for _ in range(700)] + [None] * 300
    times += [hot + dt.timedelta(minutes=random.randrange(-9000, 9000)) for _ in range(400)]
    random.shuffle(times)
    rows = [(f"call-{i:06d}" if text_keys else i, at) for i, at in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz" if text_keys else "k int, at timestamp_ntz").repartition(7).cache()
    every = [r.k for r in df.orderBy(*order()).collect()]
    sorted_rows = []
    plain = type(df).offset
    monkeypatch.setattr(type(df), "offset", lambda self, n: (sorted_rows.append(self.count()), plain(self, n))[1])
    for offset, limit in ((0, 20), (290, 30), (400, 10), (760, 25), (1100, 300), (2095, 10)):
        assert [r.k for r in listing(df).cut(offset, limit).collect()] == every[offset : offset + limit]
        assert sorted_rows[-1] <= 60 * 2 + limit  # a piece at either end, and the page


def test_keyset_pages_follow_each_other(spark):
    random.seed(8)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, random.choice([None, *(start + dt.timedelta(hours=h) for h in range(9))])) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz").repartition(4)
    every = df.orderBy(*order()).collect()
    spans, got = [], listing(df).cut(0, 30).collect()
    while len(got) < 200:
        page = listing(df, spans).after(got[-1]["at"], got[-1].k, 30).collect()
        assert page
        got += page
    assert got == every and listing(df).after(got[-1]["at"], got[-1].k, 30).count() == 0
    assert [s.high is not None for s in spans if s] and any(s is not None for s in spans)


def test_days_are_counted_from_the_newest(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None if i % 40 == 0 else start + dt.timedelta(hours=7 * i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz").withColumn("created_date", F.to_date("at"))
    df.write.partitionBy("created_date").parquet(str(tmp_path / "t"))
    stored, spans = spark.read.parquet(str(tmp_path / "t")), []

    def source(span):
        spans.append(span)
        return stored if span is None else span.of(stored, "at", "created_date")

    keys = Keys(source, "at", "k", order(), stored)
    every = [r.k for r in stored.orderBy(*order()).collect()]
    for offset, limit in ((0, 20), (5, 3), (200, 20), (390, 50), (400, 5)):
        spans.clear()
        assert [r.k for r in keys.cut(offset, limit).collect()] == every[offset : offset + limit]
        if offset + limit < 100:
            assert min((s.low for s in spans if s.low), default=dt.datetime.max) > start + dt.timedelta(days=80)  # the old days stay unread

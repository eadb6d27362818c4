"""Updates of stored tables: touched parts alone are rewritten, and hold what the whole-table form holds."""

import os

import pytest
from pyspark.sql import functions as F

from callqc.operators import merges
from callqc.plans.stored import shared_folder
from callqc.sources import sinks, updates
from callqc.sources.fixtures import FIXTURE_REVIEW_ID_OFFSET, fixture_tables, review_submissions
from callqc.sources.tables import load_parquet

SF = "/root/testdata/sf0.001"


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def rows(df):
    return sorted(map(str, df.select(sorted(c for c in df.columns if c not in ("call_date", "created_date"))).collect()))


def test_untouched_days_keep_their_files(spark, tmp_path):
    base, t = str(tmp_path / "qc"), fixture_tables(spark, SF)
    sinks.write_tables(t, base)
    stored = load_parquet(spark, base)
    before = {n: files(f"{base}/{n}") for n in os.listdir(base)}
    # submissions of analyses of two days, and ids that do not exist
    few = review_submissions(spark, SF).where("(analysis_id - 5000000000) % 1000 BETWEEN 40 AND 70 OR analysis_id > 5000000995")
    merge = merges.submit_reviews(stored, few, lambda a: a + F.lit(FIXTURE_REVIEW_ID_OFFSET))
    new_ca, new_cl = merges.review_status_updates(stored, merge.accepted)
    want = [rows(merge.reviews), rows(new_ca), rows(new_cl)]
    changed = [n for n in (merge.changed.count(),)][0]
    parts = updates.apply_reviews(spark, base, stored, merge)
    after = load_parquet(spark, base)
    assert [rows(after.conversation_review_human), rows(after.conversation_analysis), rows(after.conversations_log)] == want and changed
    for name, touched in parts.items():
        own = files(f"{base}/{name}")
        folders = {os.path.dirname(f) for f in before[name]}
        gone = {os.path.dirname(f) for f in before[name] - own}
        assert 0 < touched < len(folders) and len(gone) <= touched
        assert {f for f in before[name] if os.path.dirname(f) not in gone} <= own
    # sent again, the same submissions leave the same rows
    spark.catalog.refreshByPath(base)
    again = merges.submit_reviews(load_parquet(spark, base), few, lambda a: a + F.lit(FIXTURE_REVIEW_ID_OFFSET))
    updates.apply_reviews(spark, base, load_parquet(spark, base), again)
    assert rows(load_parquet(spark, base).conversation_review_human) == want[0]


def test_rewrite_parts_edges(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 30), (4, None, 40)], "id int, day string, v int").write.partitionBy("day").parquet(path)
    was = files(path)
    none = spark.createDataFrame([], "id int, day string, v int")
    assert updates.rewrite_parts(spark, path, "day", "id", none) == 0 and files(path) == was
    sent = spark.createDataFrame([(4, None, 41), (1, "a", None), (9, "a", 90), (3, "a", 99)], "id int, day string, v int")
    assert updates.rewrite_parts(spark, path, "day", "id", sent) == 2
    spark.catalog.refreshByPath(path)
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "day", "v").collect())) == [(1, "a", None), (2, "a", 20), (3, "b", 30), (4, None, 41)]
    assert {f for f in was if "day=b" in f} <= files(path)
    updates.rewrite_parts(spark, path, "day", "id", spark.createDataFrame([(7, "c", 70)], "id int, day string, v int"), insert=True)
    spark.catalog.refreshByPath(path)
    assert spark.read.parquet(path).where("day = 'c'").first()["v"] == 70
    with pytest.raises(ValueError):
        updates.rewrite_parts(spark, path, "day", "id", spark.createDataFrame([(7, "c", 70)], "id int, day string, w int"))


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        shared_folder(Session())


def test_temporary_tables_go_but_for_the_result(spark):
    from callqc.plans.stored import temporary_tables, written

    with temporary_tables(spark) as made:
        inner = written(spark.range(5), "inner")
        result = written(inner.where("id > 2"), "result")
        kept = made.pop()
    assert result.count() == 2 and os.path.isdir(kept.removeprefix("file:"))
    assert not any(os.path.exists(f.removeprefix("file:")) for f in made) and len(made) == 1

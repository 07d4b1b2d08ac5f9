"""Stored verdicts: written once, read by day, refused under another contract."""

import pytest
from pyspark.sql import functions as F

from urlgrove.operators import verdicts as V
from urlgrove.operators.scored import load, store
from urlgrove.plans import queries, views

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_questions_read_days_and_score_nothing(spark):
    stored = views.verdicts(spark, SF)
    assert views.verdicts(spark, SF).inputFiles() == stored.inputFiles()  # not written again
    for name in ("host_reputation", "stats_hourly", "feed_indicators", "history_page"):
        told = plan(queries.QUERIES[name](spark, SF))
        filters = told.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
        assert "day" in filters and "levenshtein" not in told and "pages.parquet" not in told
    week = V.within(stored, views.AS_OF, "7 days")
    days = {r.day for r in week.select("day").distinct().collect()}
    assert 0 < len(days) < stored.select("day").distinct().count()


def test_stored_rows_are_the_computed_ones(spark):
    cols = ["check_id", "url", "host", "score", "label", "closest_domain", "edit_distance"]
    want, got = views.computed_verdicts(spark, SF).select(*cols), views.verdicts(spark, SF).select(*cols)
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_another_contract_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "h", 5), (2, "g", None)], "check_id int, host string, s long").withColumn("checked_at", F.timestamp_seconds("s")).drop("s")
    store(df, str(tmp_path / "v"), "1")
    assert sorted((r.check_id, str(r.day)) for r in load(spark, str(tmp_path / "v"), "1").collect()) == [(1, "1970-01-01"), (2, "None")]
    with pytest.raises(ValueError):
        load(spark, str(tmp_path / "v"), "2")
    store(df.limit(0), str(tmp_path / "e"), "1")
    assert load(spark, str(tmp_path / "e"), "1").count() == 0


def test_tables_of_a_batch_go_with_it(spark):
    from urlgrove.tables import exists, stored, temporary

    path = lambda df: df.inputFiles()[0].rsplit("/", 1)[0]
    with temporary(spark):
        inner = path(stored(spark.range(3).toDF("x"), "t"))
        with pytest.raises(ZeroDivisionError), temporary(spark):
            lost = path(stored(spark.range(3).toDF("x"), "t"))
            1 / 0  # noqa: B018
        assert exists(spark, inner) and not exists(spark, lost)
    kept = path(stored(spark.range(3).toDF("x"), "t"))
    assert not exists(spark, inner) and exists(spark, kept)

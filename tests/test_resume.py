"""Work in parts: a failed part doesn't stop others, a later run does what is left, nothing is done twice."""

import pytest
from pyspark.sql import functions as F

from orrery.operators.resume import Resumable


def test_a_run_goes_on_where_one_failed(spark, tmp_path):
    items = spark.createDataFrame([(i if i else None, i) for i in range(60)], "k long, n long")
    job = Resumable(spark, f"{tmp_path}/w")
    with pytest.raises(ValueError, match="no finished part"):
        job.results()
    job.deal(items, "k", parts=8)
    job.deal(items.limit(0), "k", parts=3)  # the items are fixed
    parts = job.parts()
    calls = []

    def work(rows, bad=frozenset()):
        keys = {r.n for r in rows.select("n").collect()}
        calls.append(keys)
        return rows.select("k", F.when(F.col("n").isin(*bad), F.raise_error(F.lit("broken item")).cast("long")).otherwise(F.col("n") * 2).alias("twice"))

    first = job.run(lambda rows: work(rows, {7}), most=4)
    assert len(first.finished) + len(first.failed) == 4 and first.skipped == []
    second = Resumable(spark, f"{tmp_path}/w").run(lambda rows: work(rows, {7}))  # another process
    assert set(first.finished) == set(second.skipped) and len(first.failed) + len(second.failed) >= 1
    assert all("broken item" in e for e in second.failed.values()) and len(second.failed) == 1
    third = job.run(work)
    assert third.finished == list(second.failed) and third.failed == {} and sorted(third.skipped + third.finished) == parts == job.finished()
    assert sorted(r.twice for r in job.results().collect()) == [2 * i for i in range(60)]
    done = len(calls)
    assert job.run(work).finished == [] and len(calls) == done
    assert sum(7 in c for c in calls) >= 2 and sum(8 in c for c in calls) <= 3


def test_no_items(spark, tmp_path):
    job = Resumable(spark, f"{tmp_path}/w")
    job.deal(spark.createDataFrame([], "k long"), "k")
    assert job.parts() == [] and job.run(lambda x: x).finished == []

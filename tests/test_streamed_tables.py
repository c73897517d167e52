"""Streams over a table that is a folder of files give what they give over one file."""

import shutil

from orrery.plans import catalog


def rows(df):
    return sorted(map(str, df.collect()))


def test_folders_of_files(spark, small, tmp_path):
    for name in ("events", "pages"):
        spark.read.parquet(f"{small}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for query in ("stream_discover", "stream_counts", "stream_runs", "stream_signals"):
        want = rows(catalog.QUERIES[query](spark, small))
        assert want and rows(catalog.QUERIES[query](spark, str(tmp_path))) == want


def test_other_files_beside_the_table(spark, small, tmp_path):
    for name in ("pages", "events"):
        shutil.copy(f"{small}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    assert rows(catalog.QUERIES["stream_counts"](spark, str(tmp_path))) == rows(catalog.QUERIES["stream_counts"](spark, small))

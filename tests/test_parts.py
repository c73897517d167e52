"""Tables in parts: upserts touch the parts of their keys, failures leave the last version, results equal a fold."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators.parts import PartedTable

SCHEMA = "k string, n long, v string"


def rows(df):
    return {r.k: (r.n, r.v) for r in df.collect()}


def test_upserts_equal_a_fold(spark, tmp_path):
    rnd, table = random.Random(3), PartedTable(spark, f"{tmp_path}/t", ["k"], parts=8)
    want = {(f"k{i}" if i else None): (i, f"v{i}") for i in range(200)}
    table.create(spark.createDataFrame([(k, *x) for k, x in want.items()], SCHEMA))
    assert rows(table.read()) == want
    history = [dict(want)]
    for step in range(3):
        batch = {k: (rnd.randint(1, 9), f"s{step}", rnd.random() < 0.3) for k in rnd.sample([*want, *(f"new{step}-{i}" for i in range(30))], 40)}
        df = spark.createDataFrame([(k, *x) for k, x in batch.items()], SCHEMA + ", gone boolean")
        table.upsert(df, merged={"n": lambda old, new: old + new}, delete=F.col("gone"))
        for k, (n, v, gone) in batch.items():
            if gone:
                want.pop(k, None)
            else:
                want[k] = (want[k][0] + n if k in want else n, v)
        history.append(dict(want))
        assert rows(table.read()) == want
    assert [rows(table.read(v)) for v in table.versions()] == history and table.versions() == [1, 2, 3, 4]
    assert table.vacuum(keep=2) > 0 and table.versions() == [3, 4] and rows(table.read(3)) == history[2] and rows(table.read()) == want


def test_only_touched_parts_are_written(spark, tmp_path):
    table = PartedTable(spark, f"{tmp_path}/t", ["k"], parts=50)
    table.create(spark.range(5000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("n"), F.lit("v").alias("v")))
    before = table.manifest()
    touched = table.upsert(spark.createDataFrame([(str(i), 1, "w") for i in range(5)], SCHEMA))
    after = table.manifest()
    assert 1 <= len(touched) <= 5 and {p for p in after if after[p] != before[p]} == touched and len(after) == 50
    assert table.read().filter("v = 'w'").count() == 5 and table.read().count() == 5000
    assert table.upsert(spark.createDataFrame([], SCHEMA)) == set() and table.versions() == [1, 2]


def test_a_failed_run_leaves_the_table(spark, tmp_path):
    table = PartedTable(spark, f"{tmp_path}/t", ["k"], parts=4)
    table.create(spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], SCHEMA))
    bad = spark.createDataFrame([("a", 5, "z"), ("c", 6, "z")], SCHEMA)
    with pytest.raises(Exception, match="no way"):
        table.upsert(bad, merged={"n": lambda old, new: F.raise_error(F.lit("no way")).cast("long")})
    assert rows(table.read()) == {"a": (1, "x"), "b": (2, "y")} and table.versions() == [1]
    table.upsert(bad)  # the next run writes over what was left
    assert rows(table.read()) == {"a": (5, "z"), "b": (2, "y"), "c": (6, "z")}
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(2, table.schema(), {})
    with pytest.raises(ValueError, match="already"):
        table.create(bad)


def test_all_rows_of_a_part_deleted(spark, tmp_path):
    table = PartedTable(spark, f"{tmp_path}/t", ["k"], parts=1)
    table.create(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    table.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA), delete=F.lit(True))
    assert table.read().count() == 0 and table.read().columns == ["k", "n", "v"] and table.versions() == [1, 2]
    table.upsert(spark.createDataFrame([("b", 1, "x")], SCHEMA))
    assert rows(table.read()) == {"b": (1, "x")}

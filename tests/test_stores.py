"""Insights that add up, pages by position, databases and semi-structured results."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import blobs
from orrery.operators import insights, paging
from orrery.sources import tables


def test_summaries_add_up(spark):
    rnd = random.Random(1)
    orgs = spark.createDataFrame([(i, f"c{i % 3}" if i % 7 else None, f"s{i % 4}") for i in range(30)], "orgid long, country string, state string")
    rows = [(rnd.randrange(35), rnd.choice(["a", "b", None]), rnd.choice("FOP")) for _ in range(200)]  # some of unknown organisations
    frame = lambda x: spark.createDataFrame(x, "orgid long, category string, status string")
    whole = insights.summary(orgs, frame(rows))
    parts = insights.merged(insights.summary(orgs, frame(rows[:3])), insights.merged(insights.summary(orgs, frame(rows[3:60])), insights.summary(orgs, frame(rows[60:]))))
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.select(whole.columns).collect()))
    got = {(r.level, r.country, r.state, r.category): (r.n_orgs, r.n_portals, r.n_covered, r.n_final) for r in insights.insights(parts).collect()}
    have = {o for o, _, _ in rows}
    assert got["total", None, None, None] == (30, 200, len(have & set(range(30))), sum(s == "F" for _, _, s in rows))
    for c in ("c0", "c1", "c2"):
        own = {i for i in range(30) if i % 7 and i % 3 == int(c[1])}
        assert got["country", c, None, None] == (len(own), sum(o in own for o, _, _ in rows), len(own & have), sum(o in own and s == "F" for o, _, s in rows))
    assert {k[3] for k in got if k[0] == "category"} == {"a", "b", ""}
    assert insights.insights(insights.summary(orgs.limit(0), frame([]))).count() == 0


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_pages_by_position(spark, tmp_path, ranges):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), (F.col("id") % 3).cast("string").alias("kind"))
    df = df.withColumn("kind", F.when(F.col("id") < 5, None).otherwise(F.col("kind"))).repartition(4)
    paging.write(df, f"{tmp_path}/p", ["kind", "id"], ranges)
    pages, want = paging.Pages(spark, f"{tmp_path}/p", ["kind", "id"]), [tuple(r) for r in df.select("kind", "id").orderBy("kind", "id").collect()]
    assert pages.total() == 1000
    for offset, limit in ((0, 10), (3, 5), (333, 70), (990, 30), (1000, 5), (5, 0), (0, 1000)):
        assert [tuple(r) for r in pages.page(offset, limit).select("kind", "id").collect()] == want[offset : offset + limit]
        assert len(pages.ranges_of(offset, limit)[0]) <= limit + 1 and (ranges == 1 or limit > 100 or len(pages.ranges_of(offset, limit)[0]) < ranges)
    last = pages.page(333, 70).collect()[-1].asDict()
    assert [tuple(r) for r in pages.after(last, 20).select("kind", "id").collect()] == want[403:423]


def test_an_empty_table_has_no_page(spark, tmp_path):
    paging.write(spark.range(0).select("id"), f"{tmp_path}/p", ["id"])
    pages = paging.Pages(spark, f"{tmp_path}/p", ["id"])
    assert pages.total() == 0 and pages.ranges_of(0, 5) == ([], 0)


def test_database_round_trip(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(i, f"https://p{i}.org", i * 1.5 if i % 3 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, url string, score double").repartition(3)
    write = lambda x: tables.into_database(x, url, "portals", ["id"], batch=50, connections=2, **options)
    assert write(df.filter("id < 300")) == 300 and write(df) == 200 and write(df.unionByName(df)) == 0
    back = tables.jdbc(spark, url, "portals", column="id", bounds=(0, 500), parts=4, **options)
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == sorted(rows)
    some = back.filter("id >= 490").select("url")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(ID), *GreaterThanOrEqual(ID,490)]" in plan.replace("id", "ID").replace("`", "").replace('"', "") and some.count() == 10
    assert tables.into_database(df.withColumn("made", F.lit("x")), url, "fewer", ["id"], columns=["id", "url"], **options) == 500
    assert [c.lower() for c in tables.jdbc(spark, url, "fewer", **options).columns] == ["id", "url"]


def test_blobs(spark):
    texts = ['{"a":{"b":[1,2,{"c":"x"}]},"n":7}', "[1", "", None, "null", '"s"', '{"n":"no number"}']
    v = blobs.read(F.col("t"))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", blobs.bad(F.col("t")).alias("bad"), blobs.value(v, "$.a.b[2].c", "string").alias("c"), blobs.value(v, "$.n", "int").alias("n")).orderBy("i").collect()
    assert [(r.bad, r.c, r.n) for r in rows] == [(False, "x", 7), (True, None, None), (True, None, None), (False, None, None), (False, None, None), (False, None, None), (False, None, None)]
    long = spark.range(1).select(blobs.written(F.struct(F.sequence(F.lit(1), F.lit(5000)).alias("ids"))).alias("t"))
    assert long.select(F.size(blobs.value(blobs.read(F.col("t")), "$.ids", "array<int>"))).first()[0] == 5000

"""What a task holds doesn't grow with the table, and repeated rows are counted."""

import duckdb
from pyspark.sql import functions as F

from orrery.operators import catalog
from orrery.plans import catalog as plans


def test_parts_of_equal_keys_are_all_counted(spark, small, tmp_path):
    part = spark.read.parquet(f"{small}/part.parquet")
    part.unionByName(part.limit(5)).unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 10**6)).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(f"SELECT pattern, n, first_part FROM ({plans.ORACLE_SQL['like_searches']}) ORDER BY ALL").fetchall()
    got = plans.QUERIES["like_searches"](spark, str(tmp_path)).select("pattern", "n", "first_part").collect()
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_cells_are_dealt_by_their_number(spark):
    portals = spark.range(900).select((F.col("id") % 90).alias("orgid"), F.concat(F.lit("n"), F.col("id") % 180).alias("name"), F.lit("c").alias("category"), F.concat(F.lit("u"), F.col("id")).alias("portal_url"))
    cells = catalog.portal_cells(portals, "orgid", "name", rows=10)
    assert cells.rdd.getNumPartitions() == 90
    got = {(r.orgid, r["name"]): (r.portals, r.n_portals) for r in cells.collect()}
    assert len(got) == 180 and got[3, "n93"] == ("u273\nu453\nu633\nu813\nu93", 5)

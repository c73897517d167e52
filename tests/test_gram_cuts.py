"""Grams leave the tasks that read texts only where a pattern has them."""

from pyspark.sql import functions as F

from orrery.operators import grams


def test_grams_leave_tasks_only_where_they_are_asked_for(spark):
    texts = spark.createDataFrame([(1, "abcabc"), (2, "xbcq"), (3, ""), (4, "é🙂bc")], "id long, text string")
    asked = grams._bitmap(grams._grams(spark.createDataFrame([(1, "abc"), (2, "🙂bc")], "id int, run string"), "run", [3], key="id").select("gram"))
    assert len(asked) == 2 << 20
    held = grams._grams(texts.repartition(1), "text", [3], key="id", bitmap=asked)
    assert sorted(r.id for r in held.collect()) == [1, 4]
    counts = grams._grams(texts, "text", [2], key=None).groupBy("gram").agg(F.sum("n").alias("n"))
    assert {r.gram: r.n for r in counts.collect()}[(ord("b") << 21) | ord("c")] == 4

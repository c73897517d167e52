"""Packs of a region: worked examples."""

from pyspark.sql import functions as F

from orrery.operators import regions

OTHER = regions.Pack("other", "Nowhere", (".nw",), (("a", "X", "/x"),), (("P", "X", "^a\\.", ""),))


def test_regions(spark):
    rows = [(["uba.edu.ar"], None), (["x.org", " .Foo.AR "], None), (["ar"], None), (["bar.com"], " argentina"), (["star.com"], "Chile"), (None, None), ([], ""), (["x.nw"], None), (["x.nw"], "Argentina")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d array<string>, c string")
    got = df.select(regions.region(F.col("d"), F.col("c"), [regions.ARGENTINA, OTHER]).alias("r")).collect()
    assert [r.r for r in got] == ["argentina", "argentina", "argentina", "argentina", None, None, None, "other", "argentina"]


def test_login_surfaces(spark):
    urls = ["https://guarani.uni.edu.ar/", "https://x.uni.edu.ar/G3W/a", "https://x.ar/acceso/", "https://x.ar/acceso", "https://campus.x.ar/login/index.php", "https://hippocampus.x.ar/login/index.php", "https://www.aula.x.ar/a/login/index.php?b", None, "https://a.nw/"]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select(regions.login_surface(F.col("u"), [regions.ARGENTINA, OTHER]).alias("s")).collect()
    assert [r.s and r.s.platform for r in got] == ["SIU-Guaraní", "SIU-Guaraní", None, "SIU-Guaraní", "Moodle", None, "Moodle", None, "P"]


def test_probes(spark):
    df = spark.createDataFrame([(1, ["a.ar", "A.ar", ""], "argentina"), (2, ["b.nw"], "other"), (3, ["c.org"], None)], "o int, d array<string>, r string")
    got = [tuple(r) for r in regions.probes(df, org="o", domains="d", region="r", packs=[regions.ARGENTINA, OTHER]).collect()]
    assert len(got) == len(regions.ARGENTINA.probes) + 1 and (2, "https://a.b.nw/x", "X", "other region probe: a.b.nw") in got
    assert (1, "https://moodle.a.ar/login/index.php", "LMS/Moodle", "argentina region probe: moodle.a.ar") in got

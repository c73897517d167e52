"""Scalar functions on worked examples, and properties."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.functions import rules, text, urls
from orrery.operators import cells, dedup, evaluation, feedback, keyword_context, suffix, verdicts
from orrery.sources import tables
from orrery.streaming import runs


def one(spark, make, *values):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return df.select(make(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://sist.knimbus.com:443/a", "https://sist.knimbus.com/a"), ("HTTP://A.com:80/x?utm_source=1&b=2#/?signin=true", "http://a.com/x?b=2"), ("https://a.com:8443/", "https://a.com:8443/"),
        ("https://a.com/l;jsessionid=9A?ref=worldsitelink", "https://a.com/l"), ("a.com/x?REF=1&from", "http://a.com/x"), ("", ""), ("http://a.com:443/p", "http://a.com:443/p"), ("https://a.com?x=/y", "https://a.com?x=/y"),
    ],
)
def test_canonical(spark, url, want):
    assert one(spark, urls.canonical, url) == want
    assert one(spark, lambda c: urls.canonical(urls.canonical(c)), url) == want


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (urls.registrable, "lms.nsouict.ac.in", "nsouict.ac.in"), (urls.registrable, "sub.example.com", "example.com"), (urls.registrable, "localhost", "localhost"), (urls.registrable, "ac.in", "ac.in"),
        (urls.country, "usp.br", "Brazil"), (urls.country, "x.org", "Global"), (urls.host, "https://u:p@WWW.Uni.edu:80/x", "uni.edu"), (urls.host, "a_b.c.in", "a_b.c.in"), (urls.match_key, "https://web.uni.edu/", "eb.uni.edu"),
        (urls.path_tokens, "http://a.b/login/Exam-form.php?cat=ab", ["exam", "form", "cat"]), (urls.path_parents, "http://a.b/x/y/z", ["http://a.b/x/y/", "http://a.b/x/"]), (urls.parent_hosts, "a.b.uni.ac.in", ["b.uni.ac.in", "uni.ac.in"]),
        (urls.unwrapped, "/l/?uddg=https%3A%2F%2Fa.b%2Fc&r=1", "https://a.b/c"), (urls.dedup_key, "https://a.b/c/?id=1", "https://a.b/c"), (urls.portal_key, "https://www.a.b/c/", "a.b/c"),
        (text.slug, " IIT -- Delhi! ", "iit-delhi"), (text.slug, "!!", "x"), (text.name_key, "St. Xavier's  College", "st xavier s college"), (text.acronym, "Indian Institute of Technology", "iit"), (text.acronym, "A B", ""),
        (text.cell_urls, "http://a\r\n b,https://c", ["http://a", "https://c"]), (text.cell_urls, "No portal http://a", []), (text.id_text, "12.0", "12"), (text.short_clause, " ".join("abcdefghijklmnop"), " ".join("abcdefghijklmn")),
        (text.title, "<TITLE a=b>\n x  y</title>", "x y"), (text.generator, '<meta name="generator" content="Moodle 3">', "moodle 3"), (text.visible_text, "<p>a</p><script>'</p>b'</script> c", "a c"),
        (lambda c: urls.under(c, ["b.c"]), "a.b.c", True), (lambda c: urls.under(c, ["b.c"]), "ab.c", False),
    ],
)
def test_scalar(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize(("keyword", "words", "want"), [("harvest", "the post-harvest season", False), ("harvest", "we harvest.", True), ("data mining", "Data \n mining", True), ("scrape", "éscrape", False)])
def test_keyword_boundaries(spark, keyword, words, want):
    assert one(spark, lambda c: F.rlike(c, F.lit(text.keyword_pattern(keyword))), words) is want
    assert bool(keyword_context._pattern(keyword).search(words)) is want


def test_keywords_share_coverage():
    t = keyword_context.Terms(strong=["data mining", "mining"], weak=["data"], objects=["records"], negating=["ore"], prohibitive=["may not"], near=(10, 10, 20))
    found = lambda x: [(w, c) for w, _, c, *_ in keyword_context.occurrences(x, t)[0]]
    assert found("data mining of records") == [("data mining", "prohibitive")]
    assert found("ore mining and then, far from that, mining records") == [("mining", "prohibitive")]
    assert found("may not data. mining") == [("mining", "ambiguous"), ("data", "prohibitive")]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(0, 1000)), min_size=1, max_size=30))
def test_dedup_ignores_partitions(spark, rows):
    df = spark.createDataFrame([(k, s, i) for i, (k, s, _) in enumerate(rows)], "k int, score int, pos int")
    best = lambda x: sorted(tuple(r) for r in dedup.top(x, ["k"], [F.col("score").desc(), F.col("pos").desc()]).collect())
    want = {}
    for i, (k, score, _) in enumerate(rows):
        want[k] = max(want.get(k, (-1, -1)), (score, i))
    assert best(df) == best(df.repartition(5)) == sorted((k, *v) for k, v in want.items())


def test_insert_or_ignore(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c"), (None, "m")], "k int, v string")
    assert sorted((r.k or 0, r.v) for r in dedup.insert_or_ignore(old, new, ["k"], [F.col("v")]).collect()) == [(0, "n"), (1, "a"), (2, "c")]


def test_rules(spark):
    df = spark.createDataFrame([("abc",), ("b",), (None,)], "c string")
    first = rules.first_of([(F.col("c").contains("a"), "A"), (F.col("c").contains("b"), "B")], "none")
    assert [r.x for r in df.select(first.alias("x")).collect()] == ["A", "B", "none"]
    name, score = rules.best_of([("p", F.lit(2)), ("q", F.lit(2)), ("r", F.lit(0))], "none")
    assert df.select(name.alias("n"), score.alias("s")).first()[:] == ("p", 2)
    assert df.select(rules.best_of([("p", F.lit(0))], "none")[0].alias("n")).first().n == "none"


def test_apply_rules(spark):
    rules_ = spark.createDataFrame([(2, "host", "b.c", "flag"), (1, "pattern", "fees", "active"), (3, "host", "x.b.c", "deny")], "rule_id int, rule_type string, pattern string, action string")
    df = spark.createDataFrame([(1, "http://x.b.c/fees"), (2, "http://y.b.c/fees"), (3, "http://b.cc/")], "id int, url string").withColumn("host", urls.host(F.col("url")))
    got = {r.id: (r.action, r.pattern) for r in feedback.apply_rules(df, rules_, host="host", url="url", keys=["id"]).collect()}
    assert got == {1: ("deny", "x.b.c"), 2: ("flag", "fees"), 3: ("", "")}


def test_suffix_joins(spark):
    df = spark.createDataFrame([(1, "a.x.com"), (2, "x.com"), (3, "ax.com")], "id int, host string")
    roots = spark.createDataFrame([("x.com", 1), ("a.x.com", 2)], "root string, nth int")
    assert [r.id for r in suffix.not_under(df, roots, "host", "root").collect()] == [3]
    assert {(r.id, r.root) for r in suffix.first_match(df, roots, "host", "root", "nth", ["id"]).collect()} == {(1, "x.com"), (2, "x.com")}


def test_terms_first(spark):
    rows = [("o", "https://a/privacy", "Yes"), ("o", "https://a/terms", "No"), ("p", "https://a/tos", verdicts.NONE_FOUND), ("p", "https://a/x", "Maybe")]
    df = spark.createDataFrame(rows, "org string, url string, verdict string")
    assert {r.org: r.verdict for r in verdicts.terms_first(df, "org", verdicts.is_terms_url(F.col("url"))).collect()} == {"o": "No", "p": "Maybe"}


def test_cells_and_reports(spark):
    df = spark.createDataFrame([(1, "a, b\nc"), (2, None)], "k int, cell string")
    assert [r.x for r in cells.exploded(df, "cell", "x").collect()] == ["a", "b", "c"]
    t = spark.createDataFrame([("x", "a", "b"), ("y", "a", "a"), ("z", "a", "b")], "k string, old string, new string")
    assert [tuple(r) for r in evaluation.transitions(t, "old", "new").collect()] == [("a", "b", 2)]


def test_runs(spark):
    df = spark.createDataFrame([("h", 5, 1), ("h", 5, 2), ("h", 7, 3), ("h", 5, 4)], "host string, size int, pos int")
    assert sorted((r.size, r.length, r.first) for r in runs.runs(df, "host", "size", ["pos"]).collect()) == [(5, 1, 4), (5, 2, 1), (7, 1, 3)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x")], "OrgID int, `Portal URL` string, extra string")
    assert df.select(tables.pick(df, "org id", "orgid").cast("int").alias("a"), tables.pick(df, "portal url").alias("b"), tables.pick(df, "none").alias("c")).first()[:] == (1, "", "")
    tables.write_sheet(df.withColumnRenamed("Portal URL", "url"), str(tmp_path / "s"), ["OrgID", "url"])
    assert [tuple(r) for r in tables.sheet(spark, str(tmp_path / "s")).collect()] == [("1", "")]
    grown = tables.conform(df.select(F.col("OrgID").alias("orgid")), tables.SCHEMAS["verified_orgs"])
    assert grown.columns[:2] == ["orgid", "name"] and grown.first().orgid == "1" and grown.first().name is None
    assert tables.backfilled(spark.createDataFrame([("",), ("X",)], "c string"), "c", "India").select("c").collect()[0].c == "India"
    tables.append(df.select(F.col("OrgID").alias("orgid")), str(tmp_path / "t"), tables.SCHEMAS["verified_orgs"])
    (tmp_path / "j").write_text('{"name": "a", "expected": ["x"]}\n')
    assert tables.json_lines(spark, str(tmp_path / "j"), "name string, expected array<string>").first().expected == ["x"]

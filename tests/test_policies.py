"""The validators of documents of terms: a worked example for each stage."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import ledger, policies, structure

URLS = [
    ("ftp://uni.ac.in/terms", "address"), (None, "address"), ("https://uni.ac.in/a.css?v=1", "asset"), ("https://uni.ac.in/analytics/terms", "asset"), ("https://consent.cookiebot.com/privacy", "consent"), ("https://uni.ac.in/LGPD/", "law"),
    ("https://cdn.uni.ac.in/about", "label"), ("https://cdn.uni.ac.in/privacy.html", None), ("https://uni.ac.in/about", None), ("https://x.moodle.com/about", None), ("https://other.org/about", "third party"), ("https://other.org/política", None),
    ("https://other.org/x?doc=privacy", None),
]


def judged(spark, rows, stages):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string, final_url string, status int, html string")
    shown = structure.structured(df, keep=("page_id", "url", "final_url", "status", "html"))
    return [r.stage for r in ledger.ledger(shown, stages).orderBy("page_id").select("stage").collect()]


def test_document_urls(spark):
    got = judged(spark, [(u, None, 200, "") for u, _ in URLS], policies.document_url(F.col("url"), [F.lit("uni.ac.in"), F.lit(None).cast("string")]))
    assert got == [s for _, s in URLS]


LONG, U = "we say much here " * 60, "https://uni.ac.in/terms"
STRICT = [
    (("https://else.org/terms", None, 200, LONG), "host"), (("https://uni.ac.in/errorpage", None, 200, LONG), "error url"), (("https://uni.ac.in/naac/terms", None, 200, LONG), "other document"), ((U, None, 404, LONG), "status"), ((U, None, None, LONG), "status"),
    ((U, "https://uni.ac.in/x?aspxerrorpath=/terms", 200, LONG), "final url"), ((U, None, 200, " \n"), "empty"), ((U, None, 200, None), "empty"), ((U, None, 200, "Page not found " + LONG), "error body"), ((U, None, 200, "<h1>Terms</h1>"), "size"),
    ((U, None, 200, "<h1>Terms</h1>" + "x" * 80_000), "size"), ((U, None, 200, "<title>Home</title><h1>About</h1>" + LONG), "title"), ((U, None, 200, "<h1>Our <b>Policy</b></h1>" + LONG), None), ((U, None, 200, "<h1>Terms</h1>" + LONG + "<a>x</a>" * 51), "links"),
    ((U, None, 200, "<h1>Terms</h1>" + LONG + "Tenders"), "home page"), ((U, None, 200, "<title>Terms of Use - Uni</title>short, tenders" + "<a>x</a>" * 60), None), (("https://www.sub.uni.ac.in/terms", None, 200, "<h2>a</h2><title>x legal</title>" + LONG), None),
]


def test_strict_pages(spark):
    got = judged(spark, [r for r, _ in STRICT], policies.strict_page(F.lit(["uni.ac.in"])))
    assert got == [s for _, s in STRICT] and {s for _, s in STRICT if s} == {n for n, _ in policies.strict_page(F.lit(["uni.ac.in"]))}


SAYS = "these are our words on cookie use and you agree to them " * 12
LEVEL = [
    (("https://policies.google.com/terms", None, 200, SAYS), "platform"), (("https://uni.ac.in/newsletter.pdf", None, 200, None), "file name"), (("https://uni.ac.in/privacy-policy.pdf", None, 200, None), None), ((U, None, 200, "x"), "blocked"),
    ((U, None, 200, "Just a moment " + SAYS), "blocked"), ((U, "https://else.org/terms", 200, SAYS), "final host"), ((U, "https://uni.ac.in/Home/", 200, SAYS), "home page"), ((U, "https://uni.ac.in/a?ReturnUrl=%2fterms", 200, SAYS), "login"),
    ((U, "https://uni.ac.in/users/login", 200, SAYS), "login"), ((U, None, 200, "Password. Sign in. " + SAYS), "login"), ((U, "https://uni.ac.in/oops", 200, SAYS), "error"), ((U, None, 200, "<b>" * 100 + "terms"), "content"), ((U, None, 200, "It does not exist. " + SAYS), "content"),
    (("https://uni.ac.in/world-book-and-copyright-day", None, 200, SAYS), "article"), (("https://uni.ac.in/about", None, 200, SAYS), "article"), ((U, None, 200, "other words " * 60), "words"), ((U, None, 200, SAYS), None),
]


def test_level_pages(spark):
    got = judged(spark, [r for r, _ in LEVEL], policies.level_page(F.lit(["uni.ac.in"])))
    assert got == [s for _, s in LEVEL] and {s for _, s in LEVEL if s} == {n for n, _ in policies.level_page(F.lit(["uni.ac.in"]))}


@pytest.mark.parametrize("stages", [policies.strict_page, policies.level_page])
def test_no_pages(spark, stages):
    assert judged(spark, [(U, None, 200, LONG)], stages(F.lit(["uni.ac.in"])))[0] in (None, "title", "words")

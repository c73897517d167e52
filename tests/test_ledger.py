"""The discovery ledger: a worked example for each rule, in order, and counts of stages."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from orrery.functions import urls
from orrery.operators import ledger
from orrery.plans import ledger as plans

POLICY = ledger.Policy(shared=["knimbus.com", "samarth.edu.in"], blocked=["blocked.com", "samarth.ac.in"], labels=["portal", "exam"])
ORG = {"orgid": 1, "primary": "uni.ac.in", "domains": ["uni.edu"], "extra_domains": ["sister.org"], "extra_labels": ["sol"], "extra_roots": ["hosted.net"], "state": "Bihar", "exact": ["uniname", "pu"], "auto": ["auto1", "iiit"], "acronym": "UNIV", "anchored": ["linked.org"]}
SCHEMA = (
    "orgid long, primary string, domains array<string>, extra_domains array<string>, extra_labels array<string>, extra_roots array<string>, state string, exact array<string>, auto array<string>, acronym string, anchored array<string>, "
    "url string, category string, password boolean, bypass boolean, score int, pos long"
)
FIELDS = [f.split(" ")[0] for f in SCHEMA.split(", ")]


def frame(spark, rows):
    made = []
    for i, r in enumerate(rows):
        row = ORG | {"category": "c", "password": False, "bypass": False, "score": 1, "pos": i} | r
        made.append(tuple(row[f] for f in FIELDS))
    return spark.createDataFrame(made, SCHEMA).withColumn("host", urls.host(F.col("url")))


MEMBERS = [
    ("https://", {}, False, "no host"),
    ("https://x.mkcl.org/", {}, False, "platform of another state"),
    ("https://x.bihar-ums.com/", {"state": None}, False, "platform of another state"),
    ("https://bihar-ums.com/", {"extra_domains": ["bihar-ums.com"]}, False, "bare platform"),
    ("https://x.samarth.edu.in/", {"exact": [], "auto": None, "acronym": "UNI"}, False, "no names for the tenant"),
    ("https://pu.samarth.edu.in/", {}, True, "tenant"),
    ("https://student.pu.bihar-ums.com/", {}, True, "tenant"),
    ("https://lms-uniname.samarth.ac.in/", {}, True, "tenant"),
    ("https://auto1.samarth.edu.in/", {}, False, "another tenant"),  # curated names go before those of domains
    ("https://auto1.samarth.edu.in/", {"exact": []}, True, "tenant"),
    ("https://univ.samarth.edu.in/", {}, True, "tenant"),  # the acronym
    ("https://uninameadm.samarth.edu.in/", {}, True, "name within the tenant"),
    ("https://pup.samarth.edu.in/", {}, False, "another tenant"),  # names of two letters only as a whole
    ("https://WWW.Uni.ac.in/x", {}, True, "own domain"),
    ("https://exam.uni.edu/", {}, True, "below an own domain"),
    ("https://sister.org/", {}, True, "own domain"),
    ("https://linked.org/", {}, True, "linked from the home page"),
    ("https://uninameforms.in/", {}, True, "name in the domain"),
    ("https://x.auto1.net/", {}, True, "name in the domain"),
    ("https://iiit.net/", {}, False, "mismatch"),  # many share that name
    ("https://puforms.in/", {}, False, "mismatch"),
    ("https://a.knimbus.com/", {}, True, "shared platform"),
    ("https://unlike.com/", {}, False, "mismatch"),
]


def test_membership(spark):
    rows = ledger.membership(frame(spark, [{"url": u} | org for u, org, _, _ in MEMBERS]), POLICY).orderBy("pos").collect()
    assert [(r.url, r.member.ok, r.member.rule) for r in rows] == [(u, ok, rule) for u, _, ok, rule in MEMBERS]
    assert len({rule for _, _, _, rule in MEMBERS}) == 13


STAGES = [
    ({"url": "https://uni.ac.in/wp-login.php"}, "admin page", "admin path"),
    ({"url": "https://x.blocked.com/login"}, "blocklist", "blocked host"),
    ({"url": "https://pu.samarth.ac.in/"}, "blocklist", "blocked host"),
    ({"url": "https://punrec.samarth.edu.in/"}, "other tenant", "tenant not for students"),
    ({"url": "https://uni.com.br/login"}, "country", "Brazil for India"),
    ({"url": "https://www.uni.ac.in/Index.html/"}, "home page", "home page without login"),
    ({"url": "https://uni.ac.in/", "password": True, "category": "home"}, None, None),
    ({"url": "https://strange.com/login"}, "membership", "mismatch"),
    ({"url": "https://x.mkcl.org/", "bypass": True}, "membership", "platform of another state"),  # no bypass there
    ({"url": "https://vouched.knimbus.com/", "bypass": True}, None, None),
    ({"url": "https://vouched.com/", "bypass": True}, "labels", "off domain"),
    ({"url": "https://a.hosted.net/", "bypass": True}, None, None),
    ({"url": "https://ece.uni.ac.in/x"}, "labels", "labels: ece"),
    ({"url": "https://portal.artscollege.uni.ac.in/x"}, "labels", "labels: artscollege"),
    ({"url": "https://ece.uni.ac.in/login", "password": True}, None, None),  # a strong signal
    ({"url": "https://ece.uni.edu/login", "password": True}, "labels", "labels: ece"),  # not below the main domain
    ({"url": "https://sol.uni.ac.in/x"}, None, None),
    ({"url": "https://linked.org/x"}, "labels", "off domain"),
    ({"url": "https://exam.uni.ac.in/a/b", "score": 5}, "duplicate", "better one of its host and category"),
    ({"url": "https://exam.uni.ac.in/a", "score": 5}, "duplicate", "better one of its host and category"),
    ({"url": "https://exam.uni.ac.in/b/", "score": 5}, None, None),  # as short, but later
    ({"url": "https://exam.uni.ac.in/b", "score": 4}, "duplicate", "better one of its host and category"),
    ({"url": "https://exam.uni.ac.in/b", "score": 9, "category": "d"}, None, None),
    ({"url": "https://exam.uni.ac.in/c", "score": 9, "orgid": 2}, None, None),
]


def test_stages_and_counts(spark):
    seen = Observation()
    df = frame(spark, [r for r, _, _ in STAGES])
    rows = sorted(ledger.consolidated(df, POLICY, seen=seen).collect(), key=lambda r: r.pos)
    assert [(r.url, r.stage, r.reason) for r in rows] == [(c["url"], stage, reason) for c, stage, reason in STAGES]
    want = {"candidates": len(STAGES), "kept": sum(s is None for _, s, _ in STAGES)}
    assert seen.get == want | {s: sum(x == s for _, x, _ in STAGES) for s in {s for _, s, _ in STAGES} if s}
    assert set(rows[0].asDict()) == set(df.columns) | {"member", "stage", "reason"}


def test_earlier_stages_decide_first(spark):
    rows = ledger.consolidated(frame(spark, [{"url": "https://x.blocked.com/forgot-password"}, {"url": None}]).withColumn("audience", F.lit("student")), POLICY, plans.before()).orderBy("pos").collect()
    assert [(r.stage, r.reason) for r in rows] == [("prefilter", "page beside a login"), ("membership", "no host")]


@pytest.mark.parametrize("n", [1, 3])
def test_a_hot_host_of_rejected_rows(spark, n):
    df = frame(spark, [{"url": "https://strange.com/login"}] * 50 + [{"url": "https://exam.uni.ac.in/a"}] * n)
    got = ledger.consolidated(df, POLICY).groupBy("stage").count().collect()
    assert {r.stage: r["count"] for r in got} == {"membership": 50, None: 1} | ({"duplicate": n - 1} if n > 1 else {})
    assert ledger.consolidated(df.limit(0), POLICY).count() == 0

"""Scores, gates and predicates on rows whose outcomes are known by hand."""

import pytest
from pyspark.sql import functions as F

from orrery.functions import sites, text, urls
from orrery.operators import cells, discovery, evaluation, gates, keyword_context, links, verdicts
from orrery.plans import web
from orrery.streaming import runs


def column(spark, schema, rows, make):
    """The values of a column made of rows, in the order of their first field."""
    df = spark.createDataFrame(rows, schema)
    return [r[1] for r in sorted(df.select(df.columns[0], make.alias("made")).collect())]


def test_anchor_scores(spark):
    rows = [(1, "/student/login", "Student Login", ""), (2, "/ums", "UMS", "For students"), (3, "/staff/login", "Staff", ""), (4, "/alumni/student", "Alumni", ""), (5, "/about", "About us", "student"), (6, "/portal", "Portal", None)]
    assert column(spark, "id int, href string, text string, parent string", rows, discovery.student_anchor_score(F.col("href"), F.col("text"), F.col("parent"))) == [6, 2, -1, -1, 0, 0]


def test_login_shapes(spark):
    rows = [(1, "https://portal.yonsei.ac.kr/error.html"), (2, "https://campusvirtual.u.edu/x"), (3, "https://www.u.edu/Login.aspx"), (4, "https://u.edu/about"), (5, "https://idp.u.edu/"), (6, "https://x.u.edu/sso/a")]
    assert column(spark, "id int, url string", rows, discovery.login_shape(F.col("url"))) == ["", "host", "path", "", "host", "path"]


def test_lms_scores(spark):
    rows = [(1, "https://lms.u.edu/login/index.php", None), (2, "https://u.talentlms.com/", ""), (3, "https://u.edu/x", "Powered by Moodle"), (4, "https://u.edu/moodle/y", None), (5, "https://u.edu/", "plain"), (6, "https://a.edmingle.com/", None)]
    assert column(spark, "id int, url string, body string", rows, discovery.lms_score(F.col("url"), F.col("body"))) == [4, 3, 2, 2, 0, 1]


def test_candidate_scores(spark):
    rows = [(1, "https://u.edu/student/login", True), (2, "https://u.edu/staff/login", True), (3, "https://x.u.edu/a/b/c", False), (4, "https://www.u.edu/auth", False)]
    assert column(spark, "id int, url string, password boolean", rows, discovery.candidate_score(F.col("url"), F.col("password"), F.lit("u.edu"))) == [12, -3, 0, 5]


def test_form_signals(spark):
    rows = [(1, '<form action=x><input name="UserName"><INPUT type="password" id="p"></form>'), (2, "<p>no form</p>"), (3, None), (4, "<form><input type='search'></form><form >")]
    s = discovery.form_signals(F.col("html"))
    assert column(spark, "id int, html string", rows, F.struct(*s.values())) == [(1, 2, 1, True), (0, 0, 0, False), (0, 0, 0, False), (2, 1, 0, False)]


def test_label_words(spark):
    rows = [(1, "AdminLogin$UserName"), (2, "roll-no_field"), (3, "txtPRN")]
    assert column(spark, "id int, name string", rows, F.array_join(discovery.label_tokens(F.col("name")), " ")) == ["admin login user name", "roll no field", "txt prn"]


def test_strong_titles(spark):
    rows = [(1, "Disclaimer - DU"), (2, "Home - Delhi University"), (3, "Terms of Use | X - Y"), (4, "Welcome | Disclaimer")]
    assert column(spark, "id int, title string", rows, discovery.strong_title(F.col("title"), ["disclaimer", "terms of use"])) == [True, False, True, False]


def test_verdict_blocks(spark):
    rows = [(1, 'x\nVERDICT: Prohibited\nCLAUSE: "no bots"\nREASON: says so'), (2, "verdict: ALLOWED"), (3, "nothing")]
    assert column(spark, "id int, text string", rows, F.struct(*discovery.verdict_block(F.col("text")).values())) == [("No", "no bots", "says so"), ("Yes", "", ""), (None, "", "")]


def test_json_in_text(spark):
    rows = [(1, 'Sure: ["a",\n "b"] done'), (2, "none")]
    assert column(spark, "id int, text string", rows, F.try_element_at(discovery.first_json(F.col("text"), "array<string>"), F.lit(2))) == ["b", None]


def test_affiliation(spark):
    places = [("hapur", "Meerut", [], ["engineering"]), ("thiruvananthapuram", "Kerala", [], []), ("western up", "Meerut", [], []), ("kerala", "KTU", ["engineering"], []), ("u.p.", "UP", [], []), ("a b c d e", "Long", [], []), ("...", "None", [], [])]
    colleges = [(1, "Thiruvananthapuram, Kerala", "Arts College"), (2, "Hapur (Western UP)", "College of Engineering"), (3, "Hapur", "Arts"), (4, "kerala", "Engineering"), (5, None, "x"), (6, "Agra, U.P.", "x"), (7, "z A-B c, d E f", "x"), (8, "", "x"), (9, "gup", None)]
    df = spark.createDataFrame(colleges, "id int, place string, name string")
    got = discovery.matched_by_place(df, spark.createDataFrame(places, "alias string, rule string, need array<string>, bar array<string>"), place="place", name="name", keys=["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "Kerala"), (2, "Meerut"), (3, "Meerut"), (4, "KTU"), (6, "UP"), (7, "Long")]


def test_tenant_peers(spark):
    df = spark.createDataFrame([(1, "s.edu", "du"), (2, "s.edu", "durec"), (3, "s.edu", "jnurec"), (4, "s.ac", "durec"), (5, "s.edu", "rec"), (6, "s.edu", "duadmission")], "id int, root string, tenant string")
    got = discovery.without_admin_peers(df, root="root", tenant="tenant", suffixes=["rec", "admission"])
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5]


def test_similarity(spark):
    rows = [(1, "a b b c", "b c b d"), (2, "same", "Same"), (3, "", None), (4, "x", "y"), (5, "b b b", "b")]
    got = discovery.similar(spark.createDataFrame(rows, "id int, x string, y string"), "x", "y")
    assert [r.ratio for r in got.orderBy("id").collect()] == [0.75, 1.0, 1.0, 0.0, 0.5]


def test_state_city(spark):
    rows = [(1, "DAV (Punjab, Jalandhar)"), (2, "IIT Delhi"), (3, None)]
    assert column(spark, "id int, name string", rows, F.struct(*discovery.state_and_city(F.col("name")).values()))[:2] == [("Punjab", "Jalandhar"), ("", "")]


def test_shells(spark):
    rows = [(1, "https://erp.u.edu/account/login", '<html><div id="root"></div></html>'), (2, "https://u.edu/x", "x" * 3000), (3, "https://u.edu/", "<noscript>Please enable JavaScript</noscript>"), (4, "https://portal.u.edu/", "tiny"), (5, "https://u.edu/", None), (6, "https://u.edu/a", "<script src=a></script>" * 3 + "<div ng-app>")]
    assert column(spark, "id int, url string, html string", rows, gates.shell_score(F.col("url"), F.col("html"))) == [4, 0, 3, 3, 0, 2]


def test_admissions(spark):
    rows = [
        (1, "https://admissions.u.edu/", "", ""), (2, "https://x.ucanapply.com/", "", ""), (3, "https://u.edu/", "Apply Online", "log in to moodle"), (4, "https://u.edu/", "Apply Online 2024", ""), (5, "https://u.edu/", "Home", "Entrance test 2024 now"),
        (6, "https://u.edu/", "", "prospectus and last date"), (7, "https://u.edu/", "", "prospectus and last date; student login"), (8, "https://u.edu/", "", "prospectus, last date, eligibility, fee waiver; student login"), (9, "https://u.edu/", None, None),
    ]
    lists = {"tokens": ["admission"], "platforms": ["ucanapply.com"], "exempt": ["moodle"], "titles": ["apply online"], "strong": ["entrance test"], "weak": ["prospectus", "last date", "eligibility", "fee waiver"], "against": ["student login"]}
    got = column(spark, "id int, url string, title string, text string", rows, gates.admission(F.col("url"), F.col("title"), F.col("text"), **lists))
    assert got == ["url", "platform", "", "title", "strong", "weak", "", "many weak", ""]


def test_audiences(spark):
    rows = [(1, "Staff Login", ["user"]), (2, "Login", ["AdminLogin$UserName"]), (3, "Student Login", None), (4, "Welcome", ["StudentLogin$x"]), (5, None, ["u"]), (6, "Student and Faculty", [])]
    who = gates.audience(F.col("headings"), F.col("names"), others=["staff", "faculty", "admin"], students=["student login", "learner"], other_names=["admin", "staff"], student_names=["student", "rollno"])
    assert column(spark, "id int, headings string, names array<string>", rows, who) == ["non_student", "non_student", "student", "student", "ambiguous", "non_student"]


def test_login_gates(spark):
    form = '<form method=post{}><input name="userid"><input type="password"></form>'
    rows = [
        (1, "https://a.edu/x", form.format("")), (2, "https://a.edu/x", form.format(' action="https://evil.com/p"')), (3, "https://a.edu/x", form.format(' action="https://www.a.edu/p"')), (4, "https://a.edu/", '<a href="/login.php"> Student <b>Login</b></a>'),
        (5, "https://a.edu/about", '<a href="/login.php">Login</a>'), (6, "https://x.samarth.edu.in/", ""), (7, "https://portal.a.edu/home", None), (8, "https://a.edu/signin", ""), (9, "https://portal.a.edu/error", ""),
    ]
    assert column(spark, "id int, url string, html string", rows, gates.login_gate(F.col("url"), F.col("html"), ["samarth.edu.in"])) == ["form", "", "form", "link", "", "shared platform", "host", "path", ""]


def test_membership(spark):
    rows = [
        (1, "du.samarth.edu.in", ["du.ac.in"], ["du"]), (2, "samarth.edu.in", ["du.ac.in"], ["du"]), (3, "xdu.samarth.edu.in", ["du.ac.in"], ["du"]), (4, "slcm.jamia.samarth.edu.in", [], ["jamia"]), (5, "lib.du.ac.in", ["du.ac.in"], ["du"]),
        (6, "du.ac.in", ["du.ac.in"], []), (7, "jamiahamdard.edu", [], ["jamia"]), (8, "x.bihar-ums.com", [], ["x"]), (9, "q.knimbus.com", [], []), (10, "other.org", ["du.ac.in"], ["du"]), (11, None, [], []),
    ]
    df = spark.createDataFrame(rows, "id int, host string, owned array<string>, names array<string>")
    got = gates.membership(df, host="host", owned="owned", names="names", platforms=["samarth.edu.in"], foreign=["bihar-ums.com"], shared=["knimbus.com"])
    want = ["tenant", "no: bare platform", "no: other tenant", "tenant", "own domain", "own domain", "short name", "no: foreign platform", "shared platform", "no: mismatch", "no host"]
    assert [r.reason for r in got.orderBy("id").collect()] == want


def test_hard_gate(spark):
    rows = [(1, 404, "a.edu", "x" * 300, ""), (2, 200, "samarth.edu.in", "x" * 300, ""), (3, 200, "a.bihar.com", "x" * 300, ""), (4, 403, "a.edu", "Just a moment" + "x" * 300, ""), (5, 401, "a.edu", "x" * 300, "/staff"), (6, 200, "a.edu", "x" * 300, "/x"), (7, None, "a.edu", None, "")]
    gate = gates.validated(status=F.col("status"), host=F.col("host"), body=F.col("body"), audience=F.col("path"), bare=["samarth.edu.in"], foreign=["bihar.com"], others=["/staff"])
    assert column(spark, "id int, status int, host string, body string, path string", rows, gate) == ["status", "bare platform", "foreign", "body", "audience", "kept", "status"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (sites.admin_path, "https://a.b/wp-admin/x", True), (sites.homepage, "https://a.b/?x", True), (sites.login_subpage, "https://a.b/Forgot", True), (sites.generic_sso, "https://login.live.com/x", True), (sites.webmail, "https://pumail.u.in/", True),
        (sites.webmail, "https://u.in:2096/", True), (sites.webmail, "https://u.in/mailing", False), (sites.academic_host, "x.ac.jp.org", True), (sites.academic_host, "u.com", False), (sites.challenge_page, "short", True),
        (sites.block_page, "Access Denied " * 9 + " ray id: 7", True), (sites.block_page, "access denied", False), (sites.block_page, "Attention Required! | Cloudflare. Sorry, you have been blocked", True), (sites.block_page, "Just a moment: access denied, ray id: 7", False),
        (sites.block_page, "just a moment " * 500 + "access denied, ray id: 7", True), (sites.login_page, "Password. Sign in", True), (sites.login_page, "Password. Sign in" + " " * 2500, False),
        (sites.dead_legal_link, '<a href="#">Privacy Policy</a>', True), (sites.dead_legal_link, '<a href="/p">Privacy Policy</a>', False), (sites.legal_page, "https://a/legal/Privacy-Policy.html", True),
        (sites.legal_page, "https://a/world-copyright-day-2021", False), (sites.legal_page, "https://a/refund-terms", False), (sites.legal_page, "https://a/", False), (sites.error_url, "https://a/x?aspxerrorpath=/y", True),
        (sites.other_document, "https://a/AICTE%20Approvals.pdf", "aicte"), (sites.test_host, "https://uat.a.b/", "uat"), (sites.office_label, "https://hr-portal.harvard.edu/", "hr"), (sites.office_label, "https://harvard.edu/", ""),
        (sites.college_label, "IITD", True), (sites.college_label, "123", False), (sites.college_label, "artscollege", True), (sites.anchor_key, " Student Login »", "student login"), (sites.student_host, "https://x.samarth.ac.in/a", "https://x.samarth.edu.in/a"),
        (sites.footer, '<p>x</p><div id="bottom">y</div>', '<div id="bottom">y</div>'), (sites.attribution, "<footer>Powered &amp; x <b>Designed by: Acme Labs</b></footer>", "Acme Labs"),
        (sites.legal_text, "all rights reserved; governing law " + "x" * 500, True), (sites.strong_legal, "https://a/x?p=privacy", True), (text.main_text, "<nav>n</nav><main>" + "a " * 60 + "</main><p>z</p>", ("a " * 60).strip()),
        (lambda c: web.portal_type(c), "https://erp.sathyabama.ac.in/account/login", "ERP"), (lambda c: web.portal_type(c), "https://feeportal.x.ac.in/pay", "Fee Portal"), (lambda c: web.portal_type(c), "https://coe.annauniv.edu/home", "Examination Portal"),
        (lambda c: web.portal_type(c), "https://moderncoe.edu.in/", "Student Portal"), (lambda c: web.portal_type(c), "https://x.campx.in/a", "ERP"), (lambda c: web.portal_type(c), "https://a.b.edu/login/index.php", "LMS/Moodle"),
        (lambda c: web.portal_type(c), "https://mail.uni.edu/", "Webmail"), (lambda c: web.portal_type(c), "https://dpuerp.in/x", "ERP"), (lambda c: web.portal_type(c), "https://kohacloud.in/", "Library Portal"),
        (urls.country, "uni.co", "Colombia"), (urls.registrable, "x.y.z.edu.au", "z.edu.au"),
    ],
)
def test_predicates(spark, f, value, want):
    assert spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first().x == want


@pytest.mark.parametrize("n", [1, 26, 27, 52, 53, 702, 703, 18278])
def test_column_letters(spark, n):
    want, k = "", n
    while k:
        k, r = divmod(k - 1, 26)
        want = chr(65 + r) + want
    assert spark.range(1).select(sites.column_letter(F.lit(n)).alias("x")).first().x == want


def test_links(spark):
    html = '<A class="n" HREF="https://b.org/t">T</A><a href="/z">Z</a><a href="//c.net/p?q">C <b>c</b></a><a href="mailto:x@y">m</a><a href="q.html">Q</a>'
    pages = spark.createDataFrame([(1, "https://www.a.edu/x/y", html), (2, "http://a.edu", "<a href='https://www.a.edu/p'>own</a><a href='r'>R</a>"), (3, "http://d.in/", None)], "page_id int, url string, html string")
    got = links.outbound(links.page_links(pages)).select("page_id", "pos", "target", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "https://b.org/t", "T"), (1, 2, "https://c.net/p?q", "C c")]
    stored = pages.select("page_id", urls.dedup_key(F.col("url")).alias("key")).unionByName(spark.createDataFrame([(2, "https://b.org/t")], "page_id int, key string"))
    level = {(r.page_id, r.key): r.level for r in links.two_levels(links.page_links(pages), stored).collect()}
    assert level[1, "https://b.org/t"] == 1 and level[1, "https://www.a.edu/p"] == 2 and (3, "https://b.org/t") not in level


def test_legal_set(spark):
    rows = [("h", "terms", "/a", True, 1), ("h", "terms", "/b", True, 2), ("h", None, "/c", False, 3), ("h", None, "/d", False, 4), ("h", None, "/e", False, 5), ("h", None, "/f", False, 6), ("p", "payment", "/pay", False, 7)]
    got = links.legal_set(spark.createDataFrame(rows, "host string, cat string, path string, strong boolean, id int"), host="host", category="cat", path="path", strong="strong", order=[F.col("id")])
    assert sorted(r.id for r in got.collect()) == [1, 3, 4, 5]


def test_cells_and_recall(spark):
    df = spark.createDataFrame([(1, "a\nb", "x\ny"), (2, "c\n d", "z"), (3, "", "q")], "org int, portal string, terms string")
    assert sorted(map(tuple, cells.zipped(df, "portal", "terms", ["org"]).collect())) == [(1, 0, "a", "x"), (1, 1, "b", "y"), (2, 0, "c", "N/A"), (2, 1, "d", "N/A")]
    rows = [("a", ["x.edu", "y.edu"], ["https://x.edu/login", "http://y.edu"]), ("b", ["p", "q", "r"], ["https://p.in"]), ("c", ["z"], []), ("d", [], ["u"])]
    out = evaluation.recall(spark.createDataFrame(rows, "org string, expected array<string>, found array<string>"), ["org"], "expected", "found")
    assert sorted(map(tuple, out.collect())) == [("a", 2, 2, 1.0), ("b", 1, 3, 0.3333), ("c", 0, 1, 0.0)]
    assert spark.range(1).select(evaluation.matches(F.array(F.lit("u")), F.array(F.lit("v")), F.array(F.lit("h")), F.array(F.lit("h"))).alias("x")).first().x


def test_verdict_ties(spark):
    votes = [("a", "No"), ("a", "Yes"), ("b", "Maybe"), ("b", "Yes"), ("b", "Yes"), ("c", verdicts.NONE_FOUND), ("c", verdicts.NONE_FOUND), ("d", verdicts.NONE_FOUND), ("d", "Maybe"), ("e", "No"), ("e", "Maybe")]
    got = verdicts.majority(spark.createDataFrame(votes, "org string, verdict string"), "org")
    assert {r.org: r.verdict for r in got.collect()} == {"a": "No", "b": "Yes", "c": verdicts.NONE_FOUND, "d": "Maybe", "e": "No"}


TERMS = keyword_context.Terms(
    strong=["scrape", "scraping", "crawl", "crawling", "data mining", "harvest"], weak=["archive", "index", "extract"], objects=["data", "website", "content", "records"],
    exempt=["scrape", "scraping", "crawl", "crawling", "data mining", "harvest"], negating=["without harvest"], permissive=["is permitted"], prohibitive=["may not", "must not"],
)


def test_keyword_verdicts(spark):
    clauses = [
        (1, "You may not scrape the website or its data by any means.", "No", 0.8, "scrape:prohibitive"), (2, "The post-harvest season is described on this page.", "Yes", 0.9, ""),
        (3, "Our index of courses is open; crawling of public pages is allowed for search engines.", "No", 0.8, "crawling:prohibitive,index:ambiguous"), (4, "No one shall be liable to index anything.", "Maybe", 0.35, "index:ambiguous"),
        (5, "You must not archive content and must not extract records from the database.", "No", 0.7, "archive:prohibitive,extract:prohibitive"), (6, "You must not archive pages.", "Maybe", 0.4, "archive:prohibitive"), (7, None, "Yes", 0.9, ""),
        (8, "No scraping, no crawling. " + "word " * 60, "No", 0.95, "crawling:prohibitive,scraping:prohibitive"),
    ]
    df = spark.createDataFrame([c[:2] for c in clauses], "id int, text string")
    out = {r.id: r for r in keyword_context.judge(df, TERMS, key="id", text="text").collect()}
    for i, t, verdict, confidence, found in clauses:
        r = out[i]
        assert (r.verdict, r.confidence, ",".join(f"{m.term}:{m.context}" for m in r.found)) == (verdict, confidence, found)
        assert all(m.quote == " ".join((t or "")[max(0, m.start - 100) : m.end + 100].split())[:200] for m in r.found)
    assert out[1].clause == "You may not scrape the website or its data by any means." and not out[1].conflict
    assert out[1].evidence == "1 matches: scrape (prohibitive, 'You may not scrape the website or its data by any means.')"
    assert out[7].evidence == "No restrictive keywords found" and out[8].clause.endswith("word") and len(out[8].clause.split()) == 14
    assert out[8].reason == "explicit prohibitive language: crawling, scraping"
    odd = spark.createDataFrame([(1, "To scrape is permitted here."), (2, "Work without harvest of data.")], "id int, text string")
    assert [(r.verdict, r.conflict) for r in keyword_context.judge(odd, TERMS, key="id", text="text").orderBy("id").collect()] == [("No", True), ("Yes", True)]


def test_evidence_is_cut(spark):
    many = keyword_context.Terms(strong=["aa", "bb", "cc", "dd"], weak=[], objects=[], exempt=["aa", "bb", "cc", "dd"])
    r = keyword_context.judge(spark.createDataFrame([(1, " ".join(f"{w} it's {'x' * 90}" for w in ("aa", "bb", "cc", "dd")))], "id int, text string"), many, key="id", text="text").first()
    assert r.evidence.startswith("4 matches: aa (prohibitive, 'aa itʼs ") and r.evidence.endswith(" ...and 1 more") and len(r.evidence) <= 500


def test_joined_judgements(spark):
    q = spark.createDataFrame([(1, 1, 1), (2, 9, 1), (3, 9, 9), (4, None, None)], "id int, v int, u int")
    by_v, by_u = spark.createDataFrame([(1, "V")], "v int, verdict string"), spark.createDataFrame([(1, "U")], "u int, verdict string")
    got = verdicts.cascade(q, [("v", by_v, ["v"]), ("u", by_u, ["u"])], scored=F.lit("S"))
    assert sorted((r.id, r.verdict, r.via) for r in got.collect()) == [(1, "V", "v"), (2, "U", "u"), (3, "S", "scored"), (4, "S", "scored")]
    base = spark.createDataFrame([(1, "Maybe"), (2, "No"), (3, "Maybe")], "id int, verdict string")
    up = verdicts.escalated(base, spark.createDataFrame([(1, "Yes"), (2, "Yes")], "id int, second string"), ["id"], when=F.col("verdict") == "Maybe")
    assert sorted((r.id, r.verdict, r.via) for r in up.collect()) == [(1, "Yes", "second"), (2, "No", "keyword"), (3, "Maybe", "keyword")]


def test_run_states(spark):
    """Folding batch after batch gives the runs of the whole, whatever the cuts."""
    values = [("a", v) for v in [5, 5, 5, 5, 7, 5, 5, 5, None, None, None, 7, 7]] + [("b", v) for v in [1, 1, 2, 2, 2]]
    rows = [(k, v, i) for i, (k, v) in enumerate(values)]
    whole = runs.runs(spark.createDataFrame(rows, "key string, v int, pos int"), "key", "v", ["pos"]).filter("length >= 3").groupBy("key").count()
    want = {r.key: r["count"] for r in whole.collect()}
    for cuts in ([0, 2, 3, 9, 14, 18], [0, 1, 18], [0, 18]):
        state = spark.createDataFrame([], "key string, last int, n long, n_runs long")
        for a, b in zip(cuts, cuts[1:]):
            state = runs.folded(state, spark.createDataFrame(rows[a:b], "key string, v int, pos int"), "key", "v", ["pos"], 3)
        assert {r.key: r.n_runs for r in state.collect()} == want


def test_stream_of_candidates_over_batches(spark, tmp_path):
    """Keys that an earlier batch kept don't come again, whatever the batches; a batch reads only its keys' parts."""
    from orrery.streaming import discover

    pages = [(i, f"https://h{i % 7}.org/p{i % 11}") for i in range(60)] + [(100, "https://bad.org/x"), (101, "https://h1.org/disputed")]
    for k in range(3):
        spark.createDataFrame(pages[k::3], "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    rules_ = spark.createDataFrame([(1, "host", "bad.org", "deny"), (2, "host", "h2.org", "flag")], "rule_id int, rule_type string, pattern string, action string")
    disputed = spark.createDataFrame([("https://h1.org/disputed",)], "key string")
    source = spark.readStream.schema("page_id long, url string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    where = {"table": str(tmp_path / "table"), "checkpoint": str(tmp_path / "log")}
    got = discover.discover(source, rules_, disputed, **where).collect()
    assert len({r.batch for r in got}) == 3 and sorted(r.key for r in got) == sorted({u for i, u in pages if i < 100})
    assert {r.action for r in got if r.host == "h2.org"} == {"flag"} and all(0 <= r.part < discover.PARTS for r in got)
    again = discover.discover(source, rules_, disputed, **where)  # a restart with nothing new
    assert again.count() == len(got)

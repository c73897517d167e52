"""The structure of pages against html.parser, and its questions on worked examples."""

import html
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from orrery.operators import discovery, links
from orrery.operators import structure as S
from orrery.plans import structure as plans


class Tree(HTMLParser):
    """Elements and texts of a page by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.elements, self.stack, self.piece, self.texts = [], [], [], []

    def settle(self, *_):
        text, self.piece = "".join(self.piece).strip(), []
        if text and not any(self.elements[e][0] in S.HIDDEN for e in self.stack):
            self.texts.append((text, list(self.stack)))

    handle_comment = handle_decl = handle_pi = unknown_decl = settle

    def handle_starttag(self, tag, attrs, closed=False):
        self.settle()
        self.elements.append((tag, self.stack[-1] if self.stack else -1, {k: v or "" for k, v in attrs}))
        if tag not in S.VOID and not closed:
            self.stack.append(len(self.elements) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        self.settle()
        if any(self.elements[e][0] == tag for e in self.stack):
            while self.elements[self.stack.pop()][0] != tag:
                pass

    def handle_data(self, data):
        self.piece.append(data)

    def handle_entityref(self, name):
        self.piece.append(html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.piece.append(html.unescape(f"&#{name};"))


def parsed(page):
    t = Tree()
    t.feed(page)
    t.close()
    t.settle()
    return t


def random_page(rnd):
    names = ["div", "p", "LI", "a", "form", "main", "nav", "br", "input", "section", "h1", "title", "script", "style", "textarea", "label", "template"]
    attributes = ["", " class='x y'", ' id="q"', " href=/a/b?c=1&amp;d", " data-x disabled", " t='a>b'", ' T="1" t="2"', " q=it's", " a = 'b' c"]
    out = []
    for _ in range(rnd.randint(1, 40)):
        kind = rnd.random()
        if kind < 0.35:
            out.append("<" + rnd.choice(names) + rnd.choice(attributes) + rnd.choice([">", ">", ">", " />", "/>"]))
        elif kind < 0.6:
            out.append("</" + rnd.choice([*names, "b"]) + rnd.choice([">", " >"]))
        elif kind < 0.65:
            out.append(rnd.choice(["<!-- c <p> -->", "<!DOCTYPE html>", "<?php x ?>"]))
        else:
            out.append(rnd.choice(["text", " two words ", "\n", "&amp;", "&copy; x", "a &lt; b", "&#233;", "1 < 2 ", "x &nope; y", " ", "🙂 é"]))
    return "".join(out)


def test_elements_equal_html_parser(spark):
    rnd = random.Random(1)
    pages = [random_page(rnd) for _ in range(1500)] + ["", "no tags", "<", "<p", "a<b", "<div>" * 300 + "x" + "</p>" * 300]
    rows = S.structured(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        t = parsed(pages[r.page_id])
        assert [(e.tag, e.parent - 1, e.attrs) for e in r.elements] == t.elements, pages[r.page_id]
        assert r.text == S.SEP.join(x for x, _ in t.texts)
        for i, e in enumerate(r.elements):
            assert r.text[e.text_from : e.text_to] == S.SEP.join(x for x, stack in t.texts if i in stack)
            inner = [k for k, _ in enumerate(t.elements) if k == i or any(p == i for p in ancestors(t, k))]
            assert inner == list(range(i, e.last)) and e.depth == len(ancestors(t, i))


def ancestors(t, k):
    out = []
    while (k := t.elements[k][1]) >= 0:
        out.append(k)
    return out


def test_content_leaves_out_chrome(spark):
    rnd, chrome = random.Random(4), set(S.CHROME)
    pages = [random_page(rnd) for _ in range(600)]
    for r in S.structured(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"), small_form=12).collect():
        t = parsed(pages[r.page_id])
        live = [(x, s) for x, s in t.texts if not any(t.elements[e][0] in chrome for e in s)]
        small = {i for i, e in enumerate(t.elements) if e[0] == "form" and len(S.SEP.join(x for x, s in live if i in s)) < 12}
        live = [(x, s) for x, s in live if not small & set(s)]
        assert r.content == S.SEP.join(x for x, _ in live)
        for i, e in enumerate(r.elements):
            assert r.content[e.content_from : e.content_to] == S.SEP.join(x for x, s in live if i in s)
            assert e.dropped == any(t.elements[a][0] in chrome or a in small for a in [i, *ancestors(t, i)])


def answer(spark, page, *columns):
    return S.structured(spark.createDataFrame([(1, page)], "page_id long, html string")).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0]


LONG = "word " * 60


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><nav>menu</nav><main><div>{LONG}</div> end</main> after</body>", LONG.strip() + " end"),
        (f"<body><main>short</main><article>{LONG}<nav>in</nav></article></body>", LONG.strip()),
        (f"<body><div role=main>{LONG}<b>b</b></div>x</body>", LONG.strip() + " b"),
        (f"<body><div class='a main-content'>{LONG}<div id=Page-Content>{LONG}</div></div>x</body>", (LONG * 2).strip()),
        (f"<body><div id=main_content>{LONG[:150]}</div>x</body>", LONG[:150].strip() + " x"),
        ("<title>t</title><body>a<form>login</form><footer>f</footer>b</body>", "a b"),
        (f"<body><form runat=server>{LONG * 2}<form>inner</form></form></body>", (LONG * 2).strip()),
        ("<p>no body</p>\n<script>x</script> at all", "no body at all"),
        ("", ""),
    ],
)
def test_main_text(spark, page, want):
    assert answer(spark, page, S.main_text(F.col("elements"), F.col("content"))).c0 == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class=footer>by class</div><footer><div>a<div>b</div></div>c</footer>", "a b c"),
        ("<section class='x site-footer'>s</section><div id=bottom><div>in</div>out</div>", "in out"),
        ("<div id=footer>id</div><div class='my bottom'><div>n</div>m</div>", "n m"),
        ("<nav class=footer>n</nav><section id=bottom>s</section>", "s"),
        ("<div class=footers>x</div>", None),
    ],
)
def test_footer(spark, page, want):
    e = S.footer(F.col("elements"))
    assert answer(spark, page, S.text_of(e, F.col("text"))).c0 == want


def test_links_in_context(spark):
    page = "<ul><li>Students: <b>go <a href='/p'>por<i>tal</i></a></b></li></ul><a href=''>x</a><a>no</a><footer><p>c <a href=/t>T</a></p></footer><div><p>a</p><a href=/d>D</a></div>"
    df = S.structured(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))
    got = [(r.pos, r.href, r.text, r.parent_text, r.in_footer) for r in S.links_in_context(df).orderBy("pos").collect()]
    assert got == [(0, "/p", "portal", "Students:goportal", False), (1, "", "x", "", False), (2, "/t", "T", "cT", True), (3, "/d", "D", "aD", False)]
    assert [r.href for r in S.links_in_context(df, within=S.footer).collect()] == ["/t"]


@pytest.mark.parametrize(
    ("page", "said", "verdict", "reason"),
    [
        ("<form><input type=hidden name=h><p>Roll No</p><input name=r id=r1 placeholder='Your roll no'></form>", "your roll no r r1 roll no", "student", "identity field: roll no"),
        ("<label for=a>Challan <b>No.</b></label><table><tr><td><input id=a></td></tr></table>", "a challan no.", "non_student", "primary field: challan no"),
        ("<label>Email</label><form><input type=password></form>", "", "student", "identity field: email"),
        ("students of this semester", "", "student", "context: student"),
        ("a session", "", "non_student", "no identity field or context"),
        ("<input type=submit>", "", "ambiguous", "no text"),
        ("", "", "ambiguous", "no text"),
    ],
)
def test_form_audience(spark, page, said, verdict, reason):
    who = S.form_audience(F.col("elements"), F.col("text"), others=plans.OTHER_FIELDS, identity=plans.IDENTITY_FIELDS, context=plans.CONTEXT)
    r = answer(spark, page, S.primary_field(F.col("elements"), F.col("text")), who["verdict"], who["reason"])
    assert (r.c0, r.c1, r.c2) == (said, verdict, reason)


def test_headings_and_names(spark):
    page = "<title> A <b>x</b></title><h2>two</h2><h1>o<i>ne</i></h1>" + "".join(f"<h3>t{i}</h3>" for i in range(5)) + "<form name=F id=f><input id=i><select name=s></form>"
    r = answer(spark, page, S.headings(F.col("elements"), F.col("text")), S.control_names(F.col("elements")))
    assert (r.c0, r.c1) == ("Ax one two t0 t1 t2", ["F", "f", "i"])


def test_pages_that_repeat_or_are_empty(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", 5), (1, "<p>a</p>", 5), (None, None, None)], "page_id long, html string, text int")
    rows = S.structured(df).collect()
    assert sorted((r.page_id or 0, r.text, len(r.elements)) for r in rows) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert S.elements(df).count() == 2 and S.structured(df.limit(0)).count() == 0


def test_reading_is_linear():
    import time

    began = time.time()
    for page in ("<a <b x='" * 100_000, "<div><p class=x>t" * 30_000, "<" * 500_000, "<div>" * 20_000 + "</p>" * 50_000, "<a x=\"'>" * 50_000):
        S.Page(page)
    assert time.time() - began < 20


def test_siblings(spark):
    page = (
        "<li>For <a href='https://erp.org/in'>Student Portal</a></li><p>Staff only <a href='//hub.net/x'>Student Login</a></p><a href='https://uni.ac.in/a'>own</a><a href='https://exam.uni.ac.in/'>Exam Portal</a>"
        "<a href='https://fb.com/u'>Student Portal</a><a href='mailto:a@b.c'>m</a><a href='https://erp.org/2'>Student Portal</a><a href='/rel'>Student Portal</a><a href='https://hub.net/'>more</a>"
    )
    df = spark.createDataFrame([(1, "https://www.uni.ac.in/", "https://uni.ac.in/", page)], "page_id long, url string, primary string, html string")
    got = sorted(map(tuple, links.siblings(df, primary="primary", blocked=["fb.com"]).collect()))
    assert got == [(1, "erp.org", "https://erp.org/in", 2), (1, "hub.net", None, 2)]


def blocks(a, b, junk):
    """Characters in matching blocks: the longest block whose begin isn't junk, the first of equals; then left and right of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and b[j + k] not in junk:
                k += 1
            if k > best[2]:
                best = (i, j, k)
    i, j, k = best
    while i > 0 and j > 0 and a[i - 1] == b[j - 1] and k:  # a block grows over popular characters too
        i, j, k = i - 1, j - 1, k + 1
    while k and i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
        k += 1
    if not k:
        return 0
    return k + blocks(a[:i], b[:j], junk) + blocks(a[i + k :], b[j + k :], junk)


def test_block_ratio(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcd") for _ in range(n))
    pairs = [(None, None), ("", "a"), ("abc", "abc"), ("a" * 5000, "a" * 4096 + "b")] + [(word(rnd.randint(0, 25)), word(rnd.randint(0, 25))) for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r for r in discovery.rechecked(df, "a", "b").collect()}
    assert got[0].ratio == 1.0 and got[0].reason == "empty on one of the readings" and got[2].confirmed and got[3].ratio == 1.0
    for i, (a, b) in enumerate(pairs[4:], 4):
        want = 2 * blocks(a, b, set()) / (len(a) + len(b)) if a or b else 1.0
        assert got[i].ratio == pytest.approx(want) and got[i].confirmed == bool(a and b and want >= 0.5)

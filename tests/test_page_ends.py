"""What follows the closing tags of a page is still its body; a page's footer and maker are flags of its body."""

from pyspark.sql import functions as F

from orrery.operators import structure as S
from orrery.plans import observed
from orrery.plans.roles import candidates


def test_text_after_the_body_belongs_to_it(spark):
    page = "<html><head><title>t</title></head><body>a<div>b</body></html>c<p>d</p>"
    got = S.structured(spark.createDataFrame([(1, page)], "page_id long, html string")).select(S.main_text(F.col("elements"), F.col("content")).alias("t"), "text", "elements").first()
    assert got.t == "a b c d" and got.text == S.SEP.join("tabcd")
    assert {e.tag: e.last for e in got.elements}["body"] == len(got.elements)


def test_footer_and_maker(spark, small):
    rows = {r.page_id: r for r in observed.body_flags(spark, small).collect()}
    html = {r.page_id: r.html for r in candidates(spark, small).collect()}
    own = [i for i, h in html.items() if h.startswith('<footer class="site-footer">')]
    assert own and all(rows[i].maker == "Maker Privacy Policy" for i in own)
    assert len({r.footer_md5 for r in rows.values()}) >= 3  # none, by tag, by name

"""The five stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from orrery.llm import mixing, quality_rules, token_counts
from orrery.llm.common import stored, table
from tests.llm.test_free import MODEL, groups
from tests.llm.test_native import base_spans


@pytest.fixture(scope="module")
def chain(spark, small):
    docs, out = table(spark, small, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        out.append((name, docs, stored(f(spark, docs, small), "chain")))
        docs = out[-1][2]
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(spark, small, chain):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(after.columns == table(spark, small, "documents").columns for _, _, after in chain[:-1])


def test_quality(spark, small, chain):
    _, before, after = chain[0]
    model = quality_rules.train(before.select("doc_id", "text"), table(spark, small, "labels").select("doc_id", "quality"))
    good = {r.doc_id for r in quality_rules.score(before, model).filter("predicted = 1").collect()}
    assert set(rows(after)) == good and 0 < len(good) < before.count()
    said = {r.doc_id: r.quality for r in table(spark, small, "labels").collect()}
    assert sum(q == (d in good) for d, q in said.items()) >= 0.95 * len(said)


def test_dedup(chain):
    _, before, after = chain[1]
    want, _ = groups([(r.doc_id, r.text) for r in before.collect()], 5)
    ids = [r.doc_id for r in before.collect()]
    assert sorted(rows(after)) == sorted(d for i, d in enumerate(ids) if want[i] == d) and len(rows(after)) < len(ids)


def test_secrets(chain):
    _, before, after = chain[2]
    old, new = rows(before), rows(after)
    assert set(old) == set(new)
    for d, r in old.items():
        assert (new[d].text == r.text) if not base_spans(r.text) else new[d].text != r.text
        assert new[d].n_chars == len(new[d].text) and base_spans(new[d].text) == ""


def test_secrets_of_many_texts(spark):
    keys = {"live": "ghp_LIVElive1234567890abc", "twice": "ghp_TWICEtwice1234567890a", "often": "ghp_OFTENoften1234567890a"}
    held = [("live", "s0"), ("twice", "s0"), ("twice", "s1"), *[("often", "s0")] * 30]  # one source and language hold `often`
    df = spark.createDataFrame([(i, f"text {i} has {keys[k]} here", "en", s, 1) for i, (k, s) in enumerate(held)], "doc_id int, text string, lang string, source string, n_chars int")
    got = {r.doc_id: r.text for r in corpus_pipeline.secrets(spark, df, "").collect()}
    assert got == {i: f"text {i} has {'[example]' if k == 'often' else '[secret]'} here" for i, (k, _) in enumerate(held)}


def test_mix(chain):
    _, before, after = chain[3]
    want = Counter({r.doc_id: -(-r.taken // r.size) for r in mixing.mix(before).collect() if r.taken})
    assert Counter(r.doc_id for r in after.collect()) == want
    assert {r.doc_id: r.text for r in after.collect()}.items() <= {r.doc_id: r.text for r in before.collect()}.items()


def test_ids(chain):
    _, before, after = chain[4]
    model, texts = token_counts.load(MODEL), rows(before)
    assert after.count() == before.count() and after.filter("NOT round_trip").count() == 0
    assert all(r.ids == model.encode(texts[r.doc_id].text) for r in after.collect())


def test_run(spark, small, chain):
    got = corpus_pipeline.run(spark, small).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_ids").alias("k"))
    assert got.exceptAll(chain[-1][2].groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_ids").alias("k"))).count() == 0


def test_stages_take_odd_tables(spark, small, odd, none):
    for docs in (odd, none):
        for _, f in corpus_pipeline.STAGES:
            df = f(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), small)
            assert df.count() >= 0

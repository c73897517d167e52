"""Many patterns at once against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from orrery.operators import grams


def like(text, pattern):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        i += 1
    return re.fullmatch(out, text, re.S) is not None


def texts_of(rnd, n):
    return [None, "", "a", "ab", "%", "a_b", "100%", "\\", "日本語 🙂 é", "x" * 500] + ["".join(rnd.choice("ab c%_é🙂\n") for _ in range(rnd.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("is_like", [False, True])
def test_matches_equal_a_loop(spark, is_like):
    rnd = random.Random(int(is_like))
    texts = texts_of(rnd, 120)
    patterns = [None, "", "a", "ab", "abc", "zzz", "🙂", "日本", "a c", "xxxx"] + ["".join(rnd.choice("ab c%_é🙂") for _ in range(rnd.randint(1, 6))) for _ in range(120)]
    if is_like:
        patterns += ["%", "_%", "__", "%a%", r"%\%%", r"a\_b", r"%\\%", "a%b_c", "%ab%ab%", "%é_%"]
    patterns += patterns[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = grams.matches(df, spark.createDataFrame([(p,) for p in patterns], "pattern string"), text="text", keep=["id"], like=is_like).collect()
    holds = like if is_like else (lambda t, p: p in t)
    want = {(i, p) for i, t in enumerate(texts) for p in set(patterns) if t is not None and p is not None and holds(t, p)}
    assert len(got) == len(want) and {(r.id, r.pattern) for r in got} == want


def test_many_signatures(spark):
    """A hundred thousand signatures in one job; the ones that are there are found, with the first by order."""
    docs = spark.createDataFrame([(i, f"text {i} with sig{i * 7} and sig{i * 7 + 1} end") for i in range(300)], "id long, text string")
    signatures = spark.range(100_000).select(F.concat(F.lit("sig"), F.col("id"), F.lit(" ")).alias("pattern"), (-F.col("id")).alias("nth"))
    got = {r.id: r.pattern for r in grams.first_match(docs, signatures, text="text", key="id").collect()}
    assert got == {i: f"sig{i * 7 + 1} " for i in range(300)}


def test_bounds_and_empty_tables(spark):
    df = spark.createDataFrame([("x", "text")], "id string, text string")
    bare = spark.createDataFrame([("_" * n,) for n in range(1, 102)], "pattern string")
    with pytest.raises(ValueError, match="without a literal"):
        grams.matches(df, bare, text="text", keep=["id"], like=True)
    none = spark.createDataFrame([], "pattern string")
    assert grams.matches(df, none, text="text", keep=["id"]).count() == 0
    assert grams.matches(df.limit(0), spark.createDataFrame([("t",)], "pattern string"), text="text", keep=["id"]).count() == 0
    assert [r.x for r in spark.createDataFrame([(r"a%_\b",)], "p string").select(grams.escaped(F.col("p")).alias("x")).collect()] == [r"a\%\_\\b"]

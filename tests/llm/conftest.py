import pytest

#: Texts that each operator must take: null, empty, white space, one word, ties, repeated rows, a very long one.
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "the same words here and there again"), (6, "the same words here and there again"),
    (6, "the same words here and there again"), (None, "a row without id that has some words"), (None, None), (7, LONG), (8, "x" * 20_000), (9, "ünï ©ode 日本語 🙂 tëxt"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, size long, owner string, row long"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with null and clashing columns."""
    rows = [(i, t, None, None if k % 3 == 0 else f"s{k % 2}", None, 0.5, "k", 7, None, 3) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)

"""Equal documents are scored once in the whole table and equal queries asked once, and each copy is still listed."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("orrery.llm")

from orrery.llm import bm25_search  # noqa: E402


def by_hand(rows, k):
    """Query id, document id and score of the k best, by scoring all rows for each."""
    bags = [(i, Counter((t or "").split())) for i, t in rows]
    mean, df = sum(b.total() for _, b in bags) / len(bags), Counter(w for _, b in bags for w in b)
    idf = {w: math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    out = []
    for q, asked in bags:
        scores = [(-round(sum(n * idf[w] * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * b.total() / mean)) for w, n in asked.items() if w in b), 9), d is None, d) for d, b in bags]
        out += [(q, d, -s) for s, _, d in sorted((x for x in scores if x[0]), key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return Counter(out)


def test_copies_are_scored_once_and_listed(spark, monkeypatch):
    monkeypatch.setattr(bm25_search, "SHARD_DOCS", 10)
    monkeypatch.setattr(bm25_search, "ROW_BYTES", 200)
    texts = ["a b c d", "d c b a", "a b c d", "a b", "b a", "x y a", "x y a", "e f g"]  # two orders of one bag
    rows = [(1000 - 7 * i, texts[i % 8]) for i in range(48)] + [(5, "a b c d"), (5, "x y a"), (6, "e f g"), (6, "e f g"), (None, "a b"), (None, "q r"), (None, "q r"), (3, None)]
    seen, plain = [], bm25_search._copies
    monkeypatch.setattr(bm25_search, "_copies", lambda index, k: (seen.append(plain(index, k)), seen[-1])[1])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = bm25_search.search(df, F.lit(True), k=7).collect()
    assert Counter((r.query_id, r.doc_id, round(r.score, 9)) for r in got) == by_hand(rows, 7)
    # only the class of "a b" goes by its least id, for 12 others: 5 and 6, which two rows have, and null stand for no class
    assert seen[0][2] == 12 and {r.lead for r in seen[0][0].select("lead").collect()} == {min(i for i, t in rows if t and i and sorted(t) == sorted("a b"))}

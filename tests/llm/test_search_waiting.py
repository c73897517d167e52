"""The search's exact scores: only what is among the k best of many shards gets them, and equal to scoring all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("orrery.llm")

from orrery.llm import bm25_search  # noqa: E402


class Value:
    def __init__(self, value):
        self.value = value


def answers(monkeypatch, held):
    """The k best of 40 queries among 600 texts in shards of 50 by _answer, as by scoring all, and how many pairs were scored exactly."""
    rnd = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in (rnd.random(rnd.integers(20, 60)) ** 2 * 90).astype(int)) for _ in range(600)]
    texts[300:330] = texts[:30]
    texts[17], k, scored = "", 4, []
    for name, value in (("SHARD_DOCS", 50), ("ROW_BYTES", 2_000), ("HELD", held), ("TOGETHER", 16), ("STEP", 300)):
        monkeypatch.setattr(bm25_search, name, value)
    plain = bm25_search._scores
    monkeypatch.setattr(bm25_search, "_scores", lambda q, *rest: (scored.append(len(q)), plain(q, *rest))[1])
    ids = rnd.permutation(600)
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts})
    rows = list(bm25_search._index(Value(np.full(bm25_search.FILTER_BITS // 64, -1, np.int64)))(iter(table.to_batches(max_chunksize=100))))
    doc, hashes, counts = bm25_search.tokens(pa.array(texts))
    words, number = np.unique(hashes, return_inverse=True)
    order = np.lexsort((number, doc))
    doc, number, counts = doc[order], number[order], counts[order]
    lengths, idf = np.bincount(doc, counts, 600), np.log(1 + (600.5 - (n := np.bincount(number))) / (n + 0.5))
    mine = doc < 40
    rows_of, query = np.unique(doc[mine], return_inverse=True)
    weights, mean = (idf[number] * counts)[mine], float(lengths.mean())
    out = next(bm25_search._answer(Value((rows_of, query.astype(np.int32), words, number[mine].astype(np.int32), weights)), k, mean, True)(iter(rows)))
    got = {}
    for q, d, s in zip(*(out.column(c).to_pylist() for c in ("query_row", "doc_id", "score")), strict=True):
        got.setdefault(q, []).append((-round(s, 9), d))
    cells = np.zeros((600, len(words)))
    cells[doc, number] = counts * (bm25_search.K1 + 1) / (counts + bm25_search.K1 * (1 - bm25_search.B + bm25_search.B * lengths[doc] / mean))
    asked = np.zeros((40, len(words)))
    asked[doc[mine], number[mine]] = weights
    expected = {}
    for q in rows_of.tolist():
        s = (cells @ asked[q]).round(9)
        expected[q] = sorted((-s[d], int(ids[d])) for d in np.flatnonzero(s))[:k]
    return got, expected, sum(scored), len(rows_of) * k


@pytest.mark.parametrize("held", [0, 3_000, 10**9])
def test_answers_are_those_of_scoring_all(monkeypatch, held):
    got, expected, _, _ = answers(monkeypatch, held)
    assert {q: sorted(x) for q, x in got.items()} == expected


def test_what_later_shards_push_out_is_not_scored_exactly(monkeypatch):
    _, _, scored, least = answers(monkeypatch, 10**9)
    assert least <= scored <= 1.1 * least  # 12 shards, each with 4 best of its own, came to three times as many


def test_documents_of_one_sum_are_not_taken_for_equal():
    words, docs = np.array([0, 1, 2, 3, 0, 1, 4, 4]), np.array([0, 0, 1, 1, 2, 2, 3, 4])
    keep = bm25_search._firsts(words, docs, np.array([0.5, 1.0, 0.5, 1.0, 0.5, 1.0, 2.0, 1.5]), 6, 1)
    assert keep.tolist() == [True, True, False, True, True, True]

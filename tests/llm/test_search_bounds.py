"""The search's memory: short index rows, bounded matrices and steps, and large groups of copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("orrery.llm")

from orrery.llm import bm25_search  # noqa: E402


class Bits:
    value = np.full(bm25_search.FILTER_BITS // 64, -1, np.int64)


def indexed(texts, ids=None):
    table = pa.table({"doc_id": pa.array(ids or range(len(texts)), pa.int64()), "text": texts})
    return list(bm25_search._index(Bits)(iter(table.to_batches(max_chunksize=100))))


def test_an_index_row_is_no_longer_than_a_slice(monkeypatch):
    monkeypatch.setattr(bm25_search, "ROW_BYTES", 1_000)
    rows = indexed([f"word{i} and {'more ' * (i % 9)}text" for i in range(400)])
    assert sum(len(r.column("ids")[0]) for r in rows) == 400
    assert len(rows) >= 10 and max(r.column("size")[0].as_py() for r in rows) < 10_000


def test_a_shard_holds_the_least_of_equal_texts():
    texts = ["a b c"] * 50 + [f"b c d{i}" for i in range(5)] + ["c b a"] * 50 + ["a b c c"]
    ids = [*range(200, 306)]
    ids[10], ids[60], ids[61] = 3, 1, None  # of equal bags of words, in any order, the least ids stay
    rows = indexed(texts, ids)
    words = np.sort(bm25_search.tokens(pa.array(["a b c"]))[1])
    (found, shard), = bm25_search._shards(iter(rows), words, 3.0, 4)
    # those with d0 to d4 are the same for this question, and four of them are enough
    assert found.tolist() == [1, 3, 200, 201, 250, 251, 252, 253, 305] and len(shard.docs) == 4 * 3 + 4 * 2 + 3


@pytest.mark.parametrize("dense", [0.0, 0.05, 2.0])
def test_steps_and_columns_change_nothing(monkeypatch, dense):
    for name, value in (("DENSE", dense), ("TOGETHER", 7), ("COLUMNS", 5), ("STEP", 40), ("ALIKE_BY", 20)):
        monkeypatch.setattr(bm25_search, name, value)
    rnd = np.random.default_rng(3)
    topic = rnd.integers(0, 3, 300)
    cells = np.where((rnd.random((60, 300)) < 0.4) & (np.arange(60)[:, None] % 3 == topic), np.round(rnd.random((60, 300)), 2), 0)
    cells[:, 100:180] = cells[:, [40]]  # a large group of copies
    cells[:, 40] += cells.sum(axis=1) == 0
    words, docs = np.nonzero(cells)
    shard = bm25_search.Shard(words, docs, cells[words, docs])
    asked = [np.flatnonzero(cells[:, d]) for d in range(30, 60) if cells[:, d].any()]
    edges, flat = np.cumsum([0, *map(len, asked)]), np.searchsorted(shard.words, np.concatenate(asked))
    weights = np.round(1 + 3 * rnd.random(len(flat)), 1)
    got = {i: list(zip(docs[np.lexsort((docs, -s))].tolist(), np.sort(s)[::-1].round(9).tolist(), strict=True)) for i, docs, s in shard.best(edges, flat, weights, np.zeros(len(asked)), 300, 5)}
    for i, w in enumerate(asked):
        total = (weights[edges[i] : edges[i + 1]] @ cells[w]).round(9)
        assert got[i] == [(d, total[d]) for d in sorted(np.flatnonzero(total).tolist(), key=lambda d: (-total[d], d))[:5]]

"""Exact top-k search: BM25 over a sharded inverted index with block-max WAND.

Document frequencies, the number of documents and their mean length are taken over the whole corpus first, so a
score doesn't depend on the shard. Each shard then indexes its postings in blocks with the block's largest score,
answers the queries that have a term in it, and skips blocks whose bounds can't enter the query's top k. The shards'
lists are merged by score, then id: the result is that of scoring every document. A task hands on the best of all its
shards, so there are at most k rows for each query and task.

A query is a whole text: all its distinct words, weighed by their counts. Tasks get a bitmap of FILTER_BITS bits of
the asked words' hashes, of one size whatever the number of queries, and index only words that it lets through.
`terms` is for callers that want short queries.

Bounds of blocks don't tell documents apart for hundreds of words, so whole texts are scored another way: words that
many queries of a group of like ones share with many documents of such a group are a product of matrices of 32-bit
numbers, all others go through their postings. What comes within the rounding error of the k best so far waits, with
its postings, until HELD of them are there; what later shards haven't pushed out by then is scored again in 64 bits,
word by word in one order, so results are exact and copies tie.

The index is written as rows of ROW_BYTES of text, so that no JVM holds large pieces; a task puts its rows together to
shards, so postings are never shuffled. Documents with the same words, counts and length are one class in the whole
table: the one of least id is scored, and k ids of the class are listed where it is found; queries of one class are
asked once. Of documents that are equal to a block of queries a shard keeps the k least: no others can be among the k
best. Queries pass over the shards in blocks of QUERIES, or of QUERY_WORDS of their words
if that is less, which bounds what a task is sent; each block is one pass over the index, and its lists are written
before the next block goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import batches_of, limit_batches, new_path, setting, stored

K1, B = 1.2, 0.75
BLOCK = 64  # documents in a block
FILTER_BITS = 1 << 24
SLICE = 2_000_000  # bytes of text taken together in a task
ROW_BYTES = 500_000  # bytes of text in a row of the index, which a JVM holds whole
SHARD_DOCS, SHARD_BYTES = 5_000, 16_000_000  # documents and bytes of text in a shard
SHARDS_PER_TASK = 32  # at the most, where there are as many shards as cores
QUERIES, QUERY_WORDS = 20_000, 2_000_000  # queries sent to the shards together, and words of queries
TOGETHER = 1_024  # queries of a product of matrices
DENSE = 0.001  # share of a product's cells from which a word is cheaper there than by its postings
ALIKE, ALIKE_BY = 4, 512  # groups of like documents in a shard, and words by which they are told apart
COLUMNS = 1_024  # words of a product of matrices, which bounds the matrices
STEP = 25_000  # postings looked at together, few enough for a core's cache
HELD = 4_000_000  # postings of documents that wait for their exact scores in a task
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
TRIM = ".,;:!?\"'()[]{}|#$%&*<>=/\\-_"


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word hash) pairs, by text, with their counts: text numbers, hashes, counts."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    doc, flat = pc.list_parent_indices(lists).to_numpy(), pc.utf8_trim(lists.flatten(), characters=TRIM)
    real = pc.greater(pc.binary_length(flat), 0)
    doc, coded = doc[real.to_numpy(zero_copy_only=False)], flat.filter(real).dictionary_encode()
    size = max(1, len(coded.dictionary))
    pairs, counts = np.unique(doc.astype(np.int64) * size + coded.indices.to_numpy(), return_counts=True)
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False).view(np.int64) if len(coded.dictionary) else np.zeros(0, np.int64)
    return pairs // size, hashes[pairs % size], counts


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + size)))
        yield batch.slice(start, end - start)
        start = end


def _bits(words: DataFrame) -> np.ndarray:
    """A bitmap of the hashes in column w: at most FILTER_BITS / 64 numbers come to the driver."""
    bit = F.col("w").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = words.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(w & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _asked(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = hashes & np.int64(FILTER_BITS - 1)
    return (bits[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of a part of the index with its number of texts."""
    for batch in batches:
        for r in range(batch.num_rows):
            lengths, words, n = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("lengths", np.int32), ("words", np.int64), ("counts", np.int32)))
            # the first row has no word, but the number of texts and of their words
            w = pa.concat_arrays([pa.array([None], pa.int64()), pa.array(words)])
            n, total = np.concatenate(([len(lengths)], n)), np.concatenate(([lengths.sum(dtype=np.int64)], np.zeros(len(n), np.int64)))
            yield pa.RecordBatch.from_arrays([w, pa.array(n, pa.int64()), pa.array(total, pa.int64())], ["w", "n", "total"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of queries."""
    for batch in batches:
        for part in _slices(batch, SLICE):
            doc, hashes, counts = tokens(part.column("text"))
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays([part.column("row").take(at), part.column("doc_id").take(at), pa.array(hashes), pa.array(counts, pa.int64())], ["row", "doc_id", "w", "tf"])


def _index(bits):
    """A row for each slice of texts: ids and lengths by place, and postings by word, then place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, ROW_BYTES):
                doc, hashes, counts = tokens(part.column("text"))
                lengths, keep = np.bincount(doc, counts, part.num_rows), _asked(hashes, bits.value)
                doc, hashes, counts = doc[keep], hashes[keep], counts[keep]
                keys = _keys(doc, hashes, counts, lengths.astype(np.int64))
                by_word = np.lexsort((doc, hashes))
                words, n = np.unique(hashes[by_word], return_counts=True)
                arrays = [lengths.astype(np.int32), words, n.astype(np.int32), doc[by_word].astype(np.int32), counts[by_word].astype(np.int32)]
                columns = [pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())), *[pa.array([x.tobytes()], pa.binary()) for x in arrays], pa.array([part.nbytes], pa.int64()), *[pa.array([x], pa.list_(pa.int64())) for x in keys]]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "words", "counts", "docs", "tf", "size", "key1", "key2"])

    return run


def _keys(docs: np.ndarray, words: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """128 bits for each text, the same for those with the same words, counts and length; postings by text."""
    out, ends = np.empty((2, len(lengths)), np.uint64), np.searchsorted(docs, np.arange(len(lengths) + 1))
    for i, (a, b) in enumerate(MIX):
        x = _mixed(words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ _mixed(counts.astype(np.uint64), b, a), a, b)
        out[i] = np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))[ends]) + _mixed(lengths.astype(np.uint64), a, b)
    return out.view(np.int64)


def _mixed(x: np.ndarray, a: int, b: int) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(a)
    x = (x ^ x >> np.uint64(27)) * np.uint64(b)
    return x ^ x >> np.uint64(31)


def _copies(index: DataFrame, k: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """Documents that all queries score alike go by the one with the least id, where no other row has that id.

    Gives these ids with up to k - 1 next ones, a bit for each document that needs no scoring, and their number. The
    driver gets 20 bytes for each 64 documents of a row of the index, where some of them are copies.
    """
    each = index.select("at", F.posexplode(F.arrays_zip("ids", "key1", "key2")).alias("place", "d"))
    each = each.select("at", "place", F.coalesce("d.ids", F.lit(NO_ID)).alias("id"), "d.key1", "d.key2")
    lead = each.groupBy("key1", "key2").agg(F.count("*").alias("n"), F.min("id").alias("lead")).filter((F.col("n") > 1) & (F.col("lead") < NO_ID)).drop("n")
    once = each.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("id").alias("lead"))
    lead = stored(lead.join(once, "lead", "left_semi"), "leads")
    copies = stored(each.join(lead, ["key1", "key2"]).filter("id <> lead").select("lead", "id", "at", "place"), "copies")
    members = copies.withColumn("nth", F.row_number().over(Window.partitionBy("lead").orderBy("id"))).filter(F.col("nth") < k)
    group = F.shiftright("place", 6).alias("group")
    rows = copies.groupBy("at", group).agg(F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("bits")).orderBy("at", "group").toArrow()
    bits = tuple(rows.column(c).to_numpy() for c in ("at", "group", "bits"))
    return members.select("lead", F.nullif("id", F.lit(NO_ID)).alias("id")), bits, int(np.unpackbits(bits[2].view(np.uint8)).sum())


def _stays(dropped: tuple[np.ndarray, np.ndarray, np.ndarray], at: int, n: int) -> np.ndarray:
    """Which of n documents of a row of the index are scored."""
    a, b = np.searchsorted(dropped[0], (at, at + 1))
    out = np.zeros(-(-n // 64), np.int64)
    out[dropped[1][a:b]] = dropped[2][a:b]
    return np.unpackbits(out.view(np.uint8), bitorder="little")[:n] == 0


def _shards(batches: Iterator[pa.RecordBatch], words: np.ndarray, mean: float, k: int, dropped: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, Shard]]:
    """Shards of some of the sorted words, by their numbers, with ids: of equal texts the k least alone, which no others can push out."""

    def joined(parts: list) -> tuple[np.ndarray, Shard]:
        ids, w, docs, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        # numbers follow ids, null ids last, so that the least number is the least id
        ascending = bool((ids[1:] >= ids[:-1]).all())
        if not ascending:
            order = np.argsort(ids, kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            ids, docs = ids[order], number[docs]
        keep = _firsts(w, docs, score, len(ids), k)
        if not keep.all():
            ids, number, stays = ids[keep], np.cumsum(keep) - 1, keep[docs]
            w, docs, score = w[stays], number[docs[stays]], score[stays]
        if ascending:  # a row's postings go by word, then document, and rows follow each other
            order = None
        else:
            order = np.argsort(docs.astype(np.uint16) if len(ids) <= 1 << 16 else docs, kind="stable")  # 16 bits at a time are sorted in linear time
        for shift in (0, 16):
            digit = (w >> shift).astype(np.uint16)
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
        return ids, Shard(w[order], docs[order], score[order])

    parts, n, size = [], 0, 0
    for batch in batches:
        for r in range(batch.num_rows):
            lengths, w, counts, docs, tf = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("lengths", np.int32), ("words", np.int64), ("counts", np.int32), ("docs", np.int32), ("tf", np.int32)))
            at = np.minimum(np.searchsorted(words, w), len(words) - 1)
            here = words[at] == w
            keep = np.repeat(here, counts)
            w, ids, share = np.repeat(at[here].astype(np.int32), counts[here]), pc.fill_null(batch.column("ids")[r].values, NO_ID).to_numpy(), 1.0
            docs, tf = docs[keep], tf[keep]
            score, number = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[docs] / mean)), np.arange(len(ids))
            if dropped is not None and not (stays := _stays(dropped, batch.column("at")[r].as_py(), len(ids))).all():
                ids, number, mine, share = ids[stays], np.cumsum(stays) - 1, stays[docs], float(stays.mean())
                w, docs, score = w[mine], docs[mine], score[mine]
            parts.append((ids, w, number[docs] + n, score))
            n, size = n + len(ids), size + share * batch.column("size")[r].as_py()
            if n >= SHARD_DOCS or size >= SHARD_BYTES:
                shard = joined(parts)
                parts, n, size = [], 0, 0  # not held while the shard is searched
                yield shard
                del shard
    if n:
        yield joined(parts)


def _firsts(words: np.ndarray, docs: np.ndarray, parts: np.ndarray, n: int, k: int) -> np.ndarray:
    """Which of n documents are among the k least of those with the same words and parts, by 128 bits of hashes."""
    # only those with as many words and the same sum, added up in one order, need hashes
    many, total = np.bincount(docs, minlength=n), np.bincount(docs, parts, minlength=n)
    order = np.lexsort((total, many))
    same = (many[order[1:]] == many[order[:-1]]) & (total[order[1:]] == total[order[:-1]])
    alike = np.zeros(n, bool)
    alike[order[1:][same]] = alike[order[:-1][same]] = True
    if not alike.any():
        return np.ones(n, bool)
    mine = alike[docs]
    words, docs, parts = words[mine], docs[mine], parts[mine]
    value = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ parts.view(np.uint64)
    sums = np.zeros((2, n), np.uint64)
    sums[0] = np.where(alike, 0, np.arange(1, n + 1))  # all others differ
    for i, (a, b) in enumerate(MIX):
        np.add.at(sums[i], docs, _mixed(value, a, b))
    order = np.lexsort((sums[1], sums[0]))  # stable, so equal ones stay ascending
    same = np.concatenate(([False], (sums[:, order[1:]] == sums[:, order[:-1]]).all(axis=0)))
    place = np.arange(n) - np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    keep = np.empty(n, bool)
    keep[order] = place < k
    return keep


class Shard:
    """Postings of one shard: per word, documents ascending, their parts of the score, and maxima by block.

    Blocks are ranges of document numbers, the same for all words. The sum of the words' maxima bounds every score
    in a block, so it is the pivot test of block-max WAND for all its documents at once.
    """

    def __init__(self, words: np.ndarray, docs: np.ndarray, parts: np.ndarray):
        """Postings by word, then document. parts: what each adds to a score, for a word of weight 1."""
        self.docs, self.parts = docs, parts
        new = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
        self.words, self.postings = words[new], np.append(new, len(words))  # where each word's postings begin

    @cached_property
    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of postings of a word in a block: where they begin, their blocks, their maxima, and each word's first run."""
        if not len(self.docs):
            return np.zeros(1, np.int64), self.docs, self.parts, np.zeros(1, np.int64)
        block = self.docs // BLOCK
        new = np.concatenate(([True], block[1:] != block[:-1]))
        new[self.postings[:-1]] = True
        new = np.flatnonzero(new)
        return np.append(new, len(self.docs)), block[new], np.maximum.reduceat(self.parts, new), np.searchsorted(new, self.postings)

    def _scored(self, runs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the postings of some runs (a word's postings in a block), in the order of words."""
        at = self.runs[0]
        begin, size = at[runs], at[runs + 1] - at[runs]
        ends = np.cumsum(size)
        postings = np.arange(ends[-1]) + np.repeat(begin - ends + size, size)
        docs, which = np.unique(self.docs[postings], return_inverse=True)
        return docs, np.bincount(which, np.repeat(weights, size) * self.parts[postings])

    def find(self, words: np.ndarray) -> np.ndarray:
        """Numbers of words in the shard, -1 for those it lacks."""
        if not len(self.words):
            return np.full(len(words), -1)
        i = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[i] == words, i, -1)

    def top(self, words: np.ndarray, idf: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best documents for words (numbers) of some weights; score and document, equal scores by least document."""
        _, in_block, most, starts = self.runs
        size = starts[words + 1] - starts[words]
        runs, weights = _ranges(starts[words], size), np.repeat(idf, size)
        if len(runs) <= 64:
            docs, scores = self._scored(runs, weights)
            order = np.lexsort((docs, -scores))[:k]
            return list(zip(scores[order].tolist(), docs[order].tolist(), strict=True))
        blocks, which = np.unique(in_block[runs], return_inverse=True)
        bounds = np.bincount(which, weights * most[runs]) * (1 + 1e-12)  # sums may round differently
        order = np.argsort(-bounds, kind="stable")
        docs, scores, floor, step, pos = np.zeros(0, np.int64), np.zeros(0), -1.0, 8, 0
        while pos < len(order) and bounds[order[pos]] >= floor:  # a block of just the floor may hold a lesser document
            chosen = np.zeros(len(blocks), bool)
            chosen[order[pos : pos + step]] = True
            mine = chosen[which]
            d, x = self._scored(runs[mine], weights[mine])
            docs, scores = np.concatenate((docs, d)), np.concatenate((scores, x))
            best = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[best], scores[best]
            floor, pos, step = (scores[-1] if len(scores) == k else -1.0), pos + step, 2 * step
        return list(zip(scores.tolist(), docs.tolist(), strict=True))

    def of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings of some documents (ascending numbers), by document, then word: where each one's begin, words (numbers) and parts."""
        number = np.full(int(max(docs.max(), self.docs.max(initial=0))) + 1, -1, np.int32)
        number[docs] = np.arange(len(docs))
        its = number[self.docs]
        mine = np.flatnonzero(its >= 0)
        its = its[mine]
        order = np.argsort(its.astype(np.uint16) if len(docs) <= 1 << 16 else its, kind="stable")
        mine = mine[order]
        word = np.repeat(np.arange(len(self.words), dtype=np.int32), np.diff(self.postings))
        return np.concatenate(([0], np.cumsum(np.bincount(its, minlength=len(docs))))), word[mine], self.parts[mine]

    def best(self, edges: np.ndarray, words: np.ndarray, weights: np.ndarray, floors: np.ndarray, n: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query, its k best of n documents with a score of its floor or more, and their scores.

        The words (numbers) and weights of query i are those from edges[i] to edges[i + 1].
        """
        found = list(self.near(edges, words, weights, floors, n, k))
        if not found:
            return
        q, docs, _, _ = (np.concatenate(x) for x in zip(*found, strict=True))
        some, at = np.unique(docs, return_inverse=True)
        starts, its_words, parts = self.of(some) if len(some) else (np.zeros(1, np.int64), words[:0], weights[:0])
        for i, which, scores in _scores(q, starts[at], np.diff(starts)[at], its_words, parts, edges, words, weights):
            top = np.lexsort((docs[which], -scores))[:k]  # any number of copies may tie
            yield i, docs[which[top]], scores[top]

    def near(self, edges: np.ndarray, words: np.ndarray, weights: np.ndarray, floors: np.ndarray, n: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """What may be among a query's k best of n documents with a score of its floor or more: queries, documents, and bounds of their scores.

        Documents and queries that are alike go together, as few words are frequent in both of two unlike groups.
        """
        size, queries = np.diff(self.postings), len(edges) - 1
        word, of_query = np.repeat(np.arange(len(size), dtype=np.int32), size), np.repeat(np.arange(queries, dtype=np.int32), np.diff(edges))

        telling = np.bincount(words, minlength=len(size)) * size
        telling = np.argpartition(telling, max(0, len(size) - ALIKE_BY))[-ALIKE_BY:]
        centres = _centres(docs_in := _incidence(telling, word, self.docs, n, len(size)))
        group, asking = np.argmax(docs_in @ centres.T, axis=1), np.argmax(_incidence(telling, words, of_query, queries, len(size)) @ centres.T, axis=1)
        del of_query
        place, some_order = np.argsort(group, kind="stable"), np.argsort(asking, kind="stable")  # documents by group, queries by group
        edge = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=len(centres)))))
        spot = np.empty(n, np.int64)
        spot[place] = np.arange(n) - np.repeat(edge[:-1], np.diff(edge))  # within its group
        of_group = group.astype(np.uint8)[self.docs]
        order = np.argsort(of_group, kind="stable")  # postings by group, then word
        spots, parts, grouped, ends = spot[self.docs[order]], self.parts[order], word[order], np.cumsum(np.bincount(of_group, minlength=len(centres)))
        held = [np.bincount(grouped[a:b], minlength=len(size)) for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)]
        begins = [a + np.cumsum(h) - h for a, h in zip(np.concatenate(([0], ends[:-1])), held, strict=True)]
        del docs_in, order, grouped, word, of_group

        column = np.full(len(size), -1)
        for first in range(0, queries, TOGETHER):
            some = some_order[first : first + TOGETHER]
            length = edges[some + 1] - edges[some]
            entry, local = _ranges(edges[some], length), np.repeat(np.arange(len(some)), length)
            w, x = words[entry], weights[entry]
            near, asked, most, steps = np.zeros((len(some), n), np.float32), np.bincount(w, minlength=len(size)), 0, 0
            for g, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                frequent = np.flatnonzero(asked * held[g] > DENSE * len(some) * (hi - lo))
                most = max(most, len(frequent))
                column[frequent] = np.arange(len(frequent))
                at = column[w]
                for c in range(0, len(frequent), COLUMNS):
                    f = frequent[c : c + COLUMNS]
                    mine = np.flatnonzero((at >= c) & (at < c + COLUMNS))
                    left, right = np.zeros((len(some), len(f)), np.float32), np.zeros((len(f), hi - lo), np.float32)
                    left.reshape(-1)[local[mine] * len(f) + (at[mine] - c)] = x[mine]
                    p = _ranges(begins[g][f], held[g][f])
                    right[np.repeat(np.arange(len(f)), held[g][f]), spots[p]] = parts[p]
                    near[:, lo:hi] += left @ right
                many = held[g][w]
                rare = np.flatnonzero((at < 0) & (many > 0))
                column[frequent] = -1
                many = many[rare]
                for i, (a, b) in enumerate(_steps(many, STEP)):
                    p, e = _ranges(begins[g][w[rare[a:b]]], many[a:b]), rare[a:b]
                    q0, q1 = local[e[0]], local[e[-1]] + 1
                    cell, part = np.repeat((local[e] - q0) * (hi - lo), many[a:b]), np.repeat(x[e], many[a:b])
                    cell += spots.take(p)
                    part *= parts.take(p)
                    near[q0:q1, lo:hi] += np.bincount(cell, part, minlength=(q1 - q0) * (hi - lo)).reshape(q1 - q0, hi - lo)
                    steps = max(steps, i + 1)

            error = (most + steps + 16) * 2.0**-22
            least = np.maximum(floors[some] * (1 - error), 1e-30).astype(np.float32)  # who shares a word has more
            reach = near >= least[:, None]
            full = np.flatnonzero(np.count_nonzero(reach, axis=1) > 4 * k) if n > k else np.zeros(0, np.int64)
            if len(full):
                least[full] = np.maximum(least[full], np.partition(near[full], n - k, axis=1)[:, n - k] * (1 - 2 * error))
                reach[full] = near[full] >= least[full, None]
            who, at = np.nonzero(reach)
            score = near[who, at].astype(np.float64)
            yield some[who], place[at], score * (1 - 2 * error), score * (1 + 2 * error)


def _scores(q: np.ndarray, begin: np.ndarray, size: np.ndarray, words: np.ndarray, parts: np.ndarray, edges: np.ndarray, asked: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """64-bit scores of pairs of a query and a document, added up word by word in one order: query, its pairs and their scores.

    A document's words and parts are those from begin on, `size` of them; query i's words and weights those from edges[i] to edges[i + 1].
    """
    top = max(int(words.max(initial=0)), int(asked.max(initial=0))) + 1
    weight_of, is_asked = np.zeros(top), np.zeros(top, bool)
    order = np.argsort(q, kind="stable")
    runs = np.flatnonzero(np.concatenate(([True], np.diff(q[order]) > 0, [True]))) if len(q) else np.zeros(1, np.int64)
    for a, b in zip(runs[:-1], runs[1:], strict=True):
        pairs = order[a:b]
        i = int(q[pairs[0]])
        its = asked[edges[i] : edges[i + 1]]
        weight_of[its], is_asked[its] = weights[edges[i] : edges[i + 1]], True
        scores = []
        for c, d in _steps(size[pairs], STEP):
            start, many = begin[pairs[c:d]], size[pairs[c:d]]
            ends = np.cumsum(many)
            w = np.concatenate([words[y : y + z] for y, z in zip(start.tolist(), many.tolist(), strict=True)])
            hit = np.flatnonzero(is_asked.take(w))
            hits = np.diff(np.searchsorted(hit, ends), prepend=0)
            part = parts.take(hit + np.repeat(start - ends + many, hits))
            scores.append(np.bincount(np.repeat(np.arange(d - c), hits), weight_of.take(w.take(hit)) * part, minlength=d - c))
        is_asked[its] = False
        yield i, pairs, np.concatenate(scores)


class Waiting:
    """The k best of each query among the shards seen, whose exact scores wait until HELD postings of theirs are there.

    Until then bounds of scores say what is among the k best so far, so what later shards push out is never scored in
    64 bits.
    """

    def __init__(self, edges: np.ndarray, numbers: np.ndarray, weights: np.ndarray, k: int):
        """Queries, as in Shard.best, with words numbered alike for all shards."""
        self.edges, self.numbers, self.weights, self.k = edges, numbers, weights, k
        self.floors = np.zeros(len(edges) - 1)
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # queries, ids and scores
        self._clear()

    def _clear(self) -> None:
        self.q, self.ids, self.begin, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.low, self.high, self.words, self.parts, self.held = np.zeros(0), np.zeros(0), [], [], 0

    def add(self, q: np.ndarray, docs: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, shard: Shard) -> None:
        """Takes what Shard.near gives."""
        some, at = np.unique(docs, return_inverse=True)
        if not len(some):
            return
        starts, words, parts = shard.of(some)
        new = q, ids[docs], self.held + starts[at], np.diff(starts)[at], low, high
        self.words.append(shard.words[words].astype(np.int32))
        self.parts.append(parts)
        self.held += len(words)
        q, low = np.concatenate((self.best[0], self.q, q)), np.concatenate((self.best[2], self.low, low))
        q, _, low, place = _best(q, np.zeros(len(q), np.int64), low, self.k)
        self.floors[q[place == self.k]] = low[place == self.k]
        old = self.q, self.ids, self.begin, self.size, self.low, self.high
        stay = np.concatenate((self.high, high)) >= self.floors[np.concatenate((self.q, new[0]))]
        self.q, self.ids, self.begin, self.size, self.low, self.high = (np.concatenate(x)[stay] for x in zip(old, new, strict=True))
        if self.held > HELD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query: queries, ids and scores."""
        if self.held:
            scores = np.empty(len(self.q))
            self.words, self.parts = np.concatenate(self.words), np.concatenate(self.parts)
            for _, pairs, its in _scores(self.q, self.begin, self.size, self.words, self.parts, self.edges, self.numbers, self.weights):
                scores[pairs] = its
            *self.best, place = _best(*(np.concatenate(x) for x in zip(self.best, (self.q, self.ids, scores), strict=True)), self.k)
            full = place == self.k
            self.floors[self.best[0][full]] = self.best[2][full]
            self._clear()
        return tuple(self.best)


def _incidence(telling: np.ndarray, words: np.ndarray, rows: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of some telling words each of n rows has, as rows of length 1."""
    column = np.full(size, -1, np.int16)
    column[telling] = np.arange(len(telling))
    at, out = column[words], np.zeros((n, len(telling)), np.float32)
    mine = np.flatnonzero(at >= 0)
    out[rows[mine], at[mine]] = 1
    out /= np.maximum(np.sqrt(np.count_nonzero(out, axis=1, keepdims=True)), 1e-9)
    return out


def _centres(rows: np.ndarray) -> np.ndarray:
    """Centres of groups of like rows: begun with rows far from each other, then moved to the means of those nearest."""
    at = int(np.argmax(rows.sum(axis=1)))
    centres, nearest = [rows[at]], rows @ rows[at]
    for _ in range(ALIKE - 1):
        at = int(np.argmin(np.where(rows.any(axis=1), nearest, np.inf)))
        centres.append(rows[at])
        nearest = np.maximum(nearest, rows @ rows[at])
    centres = np.array(centres)
    for _ in range(3):
        group = np.argmax(rows @ centres.T, axis=1)
        centres = np.stack([rows[group == g].sum(axis=0) if (group == g).any() else centres[g] for g in range(ALIKE)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return centres


def _steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of sizes that sum to `most` at the most, or are one."""
    ends, a = np.cumsum(sizes), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + size, size)


READER_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
INDEX = "ids array<bigint>, lengths binary, words binary, counts binary, docs binary, tf binary, size long, key1 array<bigint>, key2 array<bigint>"
FOUND = "query_row long, doc_id long, score double"
NO_ID = np.iinfo(np.int64).max  # stands for a null id, the last of all


def _best(q: np.ndarray, d: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, and their places: by score, then id."""
    order = np.lexsort((d, -s, q))
    q, d, s = q[order], d[order], s[order]
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    top = place < k
    return q[top], d[top], s[top], place[top] + 1


def _answer(asked, k: int, mean: float, whole: bool, dropped=None):
    """The k best of a task's shards for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, queries, words, number, weights = asked.value  # queries and words by number; by query, then word
        waiting = Waiting(np.searchsorted(queries, np.arange(len(rows) + 1)), number, weights, k)
        best, numbers = waiting.best, np.full(len(words), -1, np.int32)
        for ids, shard in _shards(batches, words, mean, k, dropped.value if dropped else None):
            numbers[shard.words] = np.arange(len(shard.words))
            at = numbers[number]
            numbers[shard.words] = -1
            here = at >= 0
            if not here.any():
                continue
            edges = np.concatenate((np.zeros(1, np.int32), np.cumsum(here, dtype=np.int32)))[waiting.edges]
            at, here = at[here], weights[here]
            if whole:
                found = shard.near(edges, at, here, waiting.floors, len(ids), k)
                waiting.add(*(np.concatenate(x) for x in zip(*found, strict=True)), ids, shard)
                continue
            tops = [shard.top(at[a:b], here[a:b], k) if b > a else [] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            found = [tuple(np.array(x) for x in zip(*((i, d, s) for s, d in top), strict=True)) for i, top in enumerate(tops) if top]
            if found:
                qs, ds, ss = (np.concatenate(x) for x in zip(*found, strict=True))
                *best, _ = _best(np.concatenate((best[0], qs)), np.concatenate((best[1], ids[ds])), np.concatenate((best[2], ss)), k)
        if whole:
            best = waiting.settle()
        yield pa.RecordBatch.from_arrays([pa.array(rows[best[0]]), pa.array(best[1], mask=best[1] == NO_ID), pa.array(best[2])], ["query_row", "doc_id", "score"])

    return run


def search(df: DataFrame, queries: Column, *, doc_id: str = "doc_id", text: str = "text", k: int = 10, terms: int | None = None) -> DataFrame:
    """query_id, rank, doc_id and score: for each row of df that `queries` selects, its k best rows of df, itself included.

    Scores are BM25 sums over all words of the query, a repeated word as often as the query has it; rows that share no
    word with a query aren't listed, so it may have fewer than k. With `terms`, a query is only its so many words that
    fewest rows have (of more than one), each once. Equal scores go by id, null ids last. A null text is empty; an empty text asks for and matches
    nothing. Repeated rows are documents, and queries, of their own. An empty table gives no rows. Other columns of
    df aren't read. Ids are whole numbers, or text that holds them. Words are split at ASCII white space, lower-cased and
    trimmed of punctuation; they are compared by 64-bit hashes.
    """
    spark = df.sparkSession
    limit_batches(spark)
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), queries.alias("asks"))
    asking = stored(docs.filter("asks").drop("asks").mapInArrow(_words, "row long, doc_id long, w long, tf long"), "queries")
    bits = spark.sparkContext.broadcast(_bits(asking))
    index = stored(docs.select("doc_id", "text").mapInArrow(_index(bits), INDEX).withColumn("at", F.monotonically_increasing_id()), "index")
    known = index.select("lengths", "words", "counts").mapInArrow(_frequencies, "w long, n long, total long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    with batches_of(spark, 4), setting(spark, READER_ROWS, "4"):
        known = stored(known, "frequencies")
    stats = known.filter("w IS NULL").first()
    count, mean = (stats["n"], stats["total"] / stats["n"]) if stats and stats["total"] else (1, 1.0)
    idf = F.log(1 + (count - F.col("n") + 0.5) / (F.col("n") + 0.5))
    # queries of the same words and counts are asked once
    same = asking.groupBy("row", "doc_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("w", "tf")).alias("key1"), F.bit_xor(F.xxhash64("w", "tf", F.lit(1))).alias("key2"))
    lead = same.groupBy("n", "key1", "key2").agg(F.min("row").alias("lead"))
    same = stored(same.join(lead, ["n", "key1", "key2"]).select(F.col("lead").alias("query_row"), F.col("doc_id").alias("query_id"), "row"), "same")
    others = stored(same.filter("row <> query_row").select("row"), "others")
    asked = asking.join(others, "row", "left_anti").join(known.select("w", "n", idf.alias("idf")), "w")
    if terms is None:
        asked = asked.withColumn("weight", F.col("idf") * F.col("tf"))
    else:
        rarest = Window.partitionBy("row").orderBy(F.col("idf").desc(), F.col("tf").desc(), "w")
        asked = asked.filter("n > 1").withColumn("nth", F.row_number().over(rarest)).filter(F.col("nth") <= terms).withColumn("weight", F.col("idf"))
    block = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    asked = stored(asked.select(F.col("row").alias("query_row"), "w", "weight", block.alias("block")), "asked")

    n, total = asked.groupBy("query_row").agg(F.count("*").alias("n")).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    members, dropped, copies = _copies(index, k)
    n_docs, size = index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_docs, size = n_docs - copies, int(size * (1 - copies / max(1, n_docs)))
    dropped = spark.sparkContext.broadcast(dropped)
    shards, cores = max(-(-n_docs // SHARD_DOCS), -(-size // SHARD_BYTES)), spark.sparkContext.defaultParallelism
    # a task that has seen several shards knows what a query's k best must beat; as many tasks as cores, or twice as many and so on, end together
    index = index.coalesce(max(1, min(shards, cores * -(-shards // (cores * SHARDS_PER_TASK)))))
    blocks, at = max(-(-n // QUERIES), -(-total // QUERY_WORDS)), new_path(spark, "found")
    for i in range(blocks):  # a pass over the index for each block of queries, written before the next is sent
        some = asked.filter(F.col("block") % blocks == i).select("query_row", "w", "weight").toArrow()
        if not some.num_rows:
            continue
        row, w, weight = (some.column(c).to_numpy() for c in ("query_row", "w", "weight"))
        order = np.lexsort((w, row))
        rows, query = np.unique(row[order], return_inverse=True)
        words, number = np.unique(w[order], return_inverse=True)
        some = spark.sparkContext.broadcast((rows, query.astype(np.int32), words, number.astype(np.int32), weight[order]))
        with batches_of(spark, 4), setting(spark, READER_ROWS, "4"):  # a row is a slice of texts
            index.mapInArrow(_answer(some, k, float(mean), terms is None, dropped), FOUND).write.parquet(f"{at}/{i}")
        some.destroy()
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    found = spark.read.schema(FOUND).option("recursiveFileLookup", True).parquet(at)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    if copies:
        found = found.drop("rank")
        more = found.join(members, F.col("doc_id") == F.col("lead")).select("query_row", F.col("id").alias("doc_id"), "score")
        found = found.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.join(same, "query_row").select("query_id", "rank", "doc_id", "score")

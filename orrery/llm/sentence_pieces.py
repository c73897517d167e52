"""SentencePiece encoding and decoding in numpy batches.

Texts are cut into words before each run of spaces, and at characters that no piece has; distinct words of a batch
are encoded once, and words of equal length advance together, a row each:

- unigram models: Viterbi. At each position the substrings that end there probe the sorted keys of the pieces; a
  vectorised maximum over their scores stores the best one's length as backpointer.
- BPE models: Viterbi over their scores would not give the library's ids, because the scores are ranks of merges
  and not log-probabilities. Here the pairs of neighbours probe the sorted keys of the merges; a vectorised maximum
  picks each row's best merge, the leftmost of equals, until none is left. Ids are the library's.

The kind is read from the model. Models are files; none is trained here.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import limit_batches

MARK = "▁"
SLICE = 2_500_000  # bytes of text encoded together
WIDE = 256  # longer words of BPE models are merged one at a time, from a queue
CELLS = 2_000_000  # of a matrix of words


class Pieces:
    """Pieces, scores and keys of a model."""

    def __init__(self, pieces: list[str], scores: list[float], *, bytes_at: dict[int, int], unknown: int, special: frozenset[int] = frozenset(), unigram: bool = False):
        self.pieces, self.scores, self.unknown, self.unigram = pieces, np.array(scores), unknown, unigram
        self.byte_ids = np.full(256, unknown, np.int32)
        for b, i in bytes_at.items():
            self.byte_ids[b] = i
        self.byte_of = {i: b for b, i in bytes_at.items()}
        self.special = special
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special and i not in self.byte_of and i != unknown}
        self.longest = max(map(len, self.ids), default=1)
        self.chars = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.edge = re.compile("([^" + re.escape("".join(sorted(self.chars))) + "])") if self.chars else re.compile("(.)", re.S)
        merges = {(self.ids[p[:k]] << 32) | self.ids[p[k:]]: i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
        self.merge_keys = np.array(sorted(merges), np.int64)
        self.merged = np.array([merges[k] for k in self.merge_keys.tolist()], np.int32)
        keys = sorted((_key(np.array([[ord(c) for c in p]], np.uint64))[0], i) for p, i in self.ids.items())
        self.piece_keys, self.piece_ids = np.array([k for k, _ in keys], np.uint64), np.array([i for _, i in keys], np.int32)
        if len(set(self.piece_keys.tolist())) < len(keys):
            raise ValueError("two pieces have one key")

    @classmethod
    def of(cls, model_file: str) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(model_file, "rb") as f:
            spec.ParseFromString(f.read())
        m, n = sentencepiece.SentencePieceProcessor(model_file=model_file), len(spec.pieces)
        special = frozenset(i for i in range(n) if m.is_control(i) or m.is_unused(i))
        return cls([p.piece for p in spec.pieces], [p.score for p in spec.pieces], bytes_at={int(spec.pieces[i].piece[3:5], 16): i for i in range(n) if m.is_byte(i)}, unknown=m.unk_id(), special=special, unigram=spec.trainer_spec.model_type == 1)

    # Words: known characters only.

    def viterbi(self, codes: np.ndarray) -> list[np.ndarray]:
        """Ids of words of one length (rows of code points) with the largest sum of scores; of equals, the longer last piece."""
        m, n = codes.shape
        best, back, took = np.full((m, n + 1), -np.inf), np.zeros((m, n + 1), np.int32), np.zeros((m, n + 1), np.int32)
        best[:, 0] = 0
        for end in range(1, n + 1):
            for size in range(min(end, self.longest), 0, -1):
                k = _key(codes[:, end - size : end])
                at = np.minimum(np.searchsorted(self.piece_keys, k), len(self.piece_keys) - 1)
                score = np.where(self.piece_keys[at] == k, best[:, end - size] + self.scores[self.piece_ids[at]], -np.inf)
                better = score > best[:, end]
                best[better, end], back[better, end], took[better, end] = score[better], size, self.piece_ids[at][better]
        out = []
        for r in range(m):
            ids, end = [], n
            while end:
                ids.append(took[r, end])
                end -= back[r, end]
            out.append(np.array(ids[::-1], np.int32))
        return out

    def _merge_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        hit = self.merge_keys[at] == key
        return np.where(hit, self.scores[self.merged[at]], -np.inf), self.merged[at]

    def merge(self, ids: np.ndarray) -> list[np.ndarray]:
        """Ids of words of one length (rows of character ids) by merging neighbours, the best score first."""
        rows, out = np.arange(len(ids)), [None] * len(ids)
        score, to = self._merge_of(ids[:, :-1], ids[:, 1:])
        while len(rows):
            at = score.argmax(1) if ids.shape[1] > 1 else np.zeros(len(rows), np.int64)
            live = score[np.arange(len(rows)), at] > -np.inf if ids.shape[1] > 1 else np.zeros(len(rows), bool)
            for r in np.flatnonzero(~live):
                out[rows[r]] = ids[r].copy()
            rows, ids, score, to, at = rows[live], ids[live], score[live], to[live], at[live]
            if not len(rows):
                break
            r, n = np.arange(len(rows)), ids.shape[1] - 1
            ids[r, at] = to[r, at]
            ids = ids[r[:, None], np.arange(n) + (np.arange(n) > at[:, None])]
            shift = np.arange(n - 1) + (np.arange(n - 1) >= at[:, None])
            score, to = score[r[:, None], shift], to[r[:, None], shift]
            for side in (at - 1, at):  # only the pairs beside the merge are new
                ok = (side >= 0) & (side < n - 1)
                score[r[ok], side[ok]], to[r[ok], side[ok]] = self._merge_of(ids[r[ok], side[ok]], ids[r[ok], side[ok] + 1])
        return out

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """As merge(), for one long word: a queue of pairs over a linked list."""
        ids, n = ids.copy(), len(ids)
        after, before, version = np.arange(1, n + 1), np.arange(-1, n - 1), np.zeros(n, np.int64)
        score, to = self._merge_of(ids[:-1], ids[1:])
        queue = [(-score[i], i, 0, 0, i + 1, to[i]) for i in np.flatnonzero(score > -np.inf)]
        heapq.heapify(queue)
        while queue:
            _, i, vi, vj, j, new = heapq.heappop(queue)
            if version[i] != vi or version[j] != vj or after[i] != j:
                continue
            ids[i], after[i], version[i], version[j] = new, after[j], vi + 1, -1
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    s, t = self._merge_of(ids[a : a + 1], ids[b : b + 1])
                    if s[0] > -np.inf:
                        heapq.heappush(queue, (-s[0], a, version[a], version[b], b, t[0]))
        keep, i = [], 0
        while i < n:
            keep.append(ids[i])
            i = after[i]
        return np.array(keep, np.int32)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word: runs of known characters, or one other character, which becomes its bytes."""
        out: list = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) == 1 and w not in self.chars:
                ids = self.byte_ids[np.frombuffer(w.encode("utf-8", "surrogatepass"), np.uint8)]
                out[i] = ids if len(self.byte_of) == 256 else np.array([self.unknown], np.int32)
            elif len(w) == 1 and not self.unigram:
                out[i] = np.array([self.chars[w]], np.int32)
            else:
                by_size.setdefault(len(w), []).append(i)
        for size, at in by_size.items():
            for start in range(0, len(at), step := max(1, CELLS // (size * 4))):
                some = at[start : start + step]
                codes = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le"), np.uint32).reshape(len(some), size)
                if self.unigram:
                    found = self.viterbi(codes.astype(np.uint64))
                else:
                    points, inverse = np.unique(codes, return_inverse=True)
                    ids = np.array([self.chars[chr(c)] for c in points], np.int32)[inverse].reshape(codes.shape)
                    found = self.merge(ids) if size <= WIDE else [self.merge_long(x) for x in ids]
                for i, x in zip(some, found, strict=True):
                    out[i] = x
        return out

    def words(self, text: str) -> list[str]:
        """The words of a text, with space marks for spaces and the leading one that encoding adds."""
        if not text:
            return []
        marked = (" " + text).replace(" ", MARK)
        return [w for part in self.edge.split(marked) if part for w in BEFORE_MARKS.split(part) if w]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = [self.words(t) for t in texts]
        sizes = np.array([len(c) for c in cut], np.int64)
        codes, distinct = pd.factorize(np.array([w for c in cut for w in c], object))
        del cut
        coded = self.encode_words(list(distinct))
        if not coded:
            return [np.zeros(0, np.int32) for _ in texts]
        lengths = np.array([len(c) for c in coded], np.int64)
        starts, flat = np.cumsum(lengths) - lengths, np.concatenate(coded)
        each = lengths[codes]
        ends = np.cumsum(each)
        ids = flat[np.arange(ends[-1]) - np.repeat(ends - each, each) + np.repeat(starts[codes], each)]
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids; bytes that are no UTF-8 become replacement characters, one each, as in the library."""
        raw = [b"" if i in self.special else bytes([self.byte_of[i]]) if i in self.byte_of else b" \xe2\x81\x87 " if i == self.unknown else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        texts = [b"".join([raw[i] for i in x.tolist()]).decode("utf-8", "replace") for x in ids]
        return [t[1:] if t[:1] == " " else t for t in texts]


BEFORE_MARKS = re.compile(f"(?<=[^{MARK}])(?={MARK})")


def _key(codes: np.ndarray) -> np.ndarray:
    """Keys of rows of code points; the rows' number of columns goes in."""
    with np.errstate(over="ignore"):
        h = np.full(len(codes), codes.shape[1], np.uint64)
        for c in codes.T:
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE)))
        yield batch.slice(start, end - start)
        start = end


def encode(df: DataFrame, model_file: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_ids and round_trip for each row of df.

    ids are the whole text's, without begin or end. round_trip: decoding them gives the text back (a space mark
    inside a text comes back as a space, and so doesn't). A null text is empty: no ids, and null and empty both
    count as a round trip. Null ids and repeated rows stay. An empty table gives no rows. Other columns of df
    aren't read. model_file is a path that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model_file)
        for batch in batches:
            for part in _slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids = pieces.encode(texts)
                same = [a == b for a, b in zip(pieces.decode(ids), texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_ids", "round_trip"])

    limit_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_ids long, round_trip boolean")


def decode(df: DataFrame, model_file: str, *, ids: str = "ids", into: str = "text") -> DataFrame:
    """df with the text of its ids in a column (replaced if it exists); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(model_file)
        for batch in batches:
            texts = pieces.decode([np.array(x or [], np.int32) for x in batch.column(ids).to_pylist()])
            at = batch.schema.get_field_index(into)
            column = pa.array(texts, pa.string())
            yield batch.append_column(into, column) if at < 0 else batch.set_column(at, into, column)

    out = df.withColumn(into, F.lit(""))
    return df.mapInArrow(run, out.schema)

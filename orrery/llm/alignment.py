"""Alignment of two tokenizers over the same bytes: a byte-level BPE (A) and a SentencePiece model (B).

A reads space+text, B the text, to which it adds that space itself; so both cut the same bytes. Offsets where tokens
of both end cut a text into groups; an A and a B token are linked where their byte ranges overlap.

1. Events: each text gives a row of end events for each side and block, (row, offset of the block's first byte,
   side, ids). A token's end is the block's offset plus the bytes of the block's tokens up to it, so ids alone are
   sent, packed: the two sides' rows are the union of A's and B's end events.
2. Sweep: the rows are dealt by document, sorted within partitions by offset, and stream through a machine. It merges the
   ends of both sides in order of bytes. Each end closes a link of the two tokens that are open there; an end of both
   sides closes a group. Between batches it keeps the tokens that are open, and the sums and hash of one document.
3. Counts: each document keeps its distinct pairs with their number of links. Tasks sum them before they are
   shuffled; each B id's highest count marks its best pairs. The most frequent pairs, at most HOT, are broadcast and
   met where the documents are; only the others go through a join, so no hot pair is shuffled.

Words are encoded once for each slice of texts and kept for later ones, at most WORDS of them. A text is cut before a
space that follows a character which is no white space: A's pattern always ends a pre-token there, and no piece of B crosses it
(checked when the model is loaded), so the words' tokens are the text's.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import limit_batches, new_path

MARK = "▁"  # stands for a space in pieces
BETWEEN = re.compile(r"(?<=\S) ")
UNEVEN = re.compile(r"\A |\s ")  # where a cut at each space would be wrong
SLICE = 1_000_000  # bytes of text encoded together
TOKENS = 1_000_000  # that are swept together, and pairs that are met together
WORDS = 300_000  # words kept with their ids
LONG = 64  # characters of a word that is kept
BLOCK = 16_384  # tokens of a row of events
HOT = 1_000_000  # pairs that are broadcast
FLUSH = 1_000_000  # pairs whose counts a task holds before it hands them on
#: The pattern of byte-level BPE's pre-tokens, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EVENTS = "row long, offset long, side int, n int, ids binary"


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Tokenizers:
    """Both tokenizers, each id's bytes, and the words encoded so far."""

    a_file: str
    b_file: str
    a_words: dict[str, bytes] = field(default_factory=dict)
    b_words: dict[str, bytes] = field(default_factory=dict)
    odd: set[str] = field(default_factory=set)  # words whose bytes don't come back

    def __post_init__(self):
        import sentencepiece
        import tiktoken

        with open(self.a_file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], {x["content"] for x in spec.get("added_tokens", [])}
        to_byte = byte_of_char()
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in added}
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        order = [vocab[x + y] for x, y in merges]
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or order != sorted(order):
            raise ValueError(f"{self.a_file}: not a byte-level BPE whose ids follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=self.b_file)
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or len(self.b.encode(f"a{MARK}  a")) != len(self.b.encode("a   a")) or self.b.encode("a ") == self.b.encode("a"):
            raise ValueError(f"{self.b_file}: pieces cross spaces, or the model trims white space")
        self.n_a, self.n_b = max(vocab.values()) + 1, len(pieces)
        if max(self.n_a, self.n_b) >= 10**7:
            raise ValueError("ids of more than seven digits")
        self.a_bytes, self.b_bytes = [b""] * self.n_a, [b""] * self.n_b
        for t, i in ranks.items():
            self.a_bytes[i] = t
        for i, p in enumerate(pieces):
            if self.b.is_byte(i):
                self.b_bytes[i] = bytes([int(p[3:5], 16)])
            elif not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i)):
                self.b_bytes[i] = p.replace(MARK, " ").encode()
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int32) for side in (self.a_bytes, self.b_bytes))
        self.lone = np.array([self.b.piece_to_id(MARK)], np.uint32).tobytes()  # the last space of a text is one piece

    def learn(self, words: list[str]) -> None:
        """Ids of the words, packed."""
        a = [self.a.encode_ordinary(" " + w) for w in words]
        b = self.b.encode(words, num_threads=1)
        for w, x, y in zip(words, a, b, strict=True):
            self.a_words[w] = np.array(x, np.uint32).tobytes()
            self.b_words[w] = np.array(y, np.uint32).tobytes() if w else self.lone
            whole = (" " + w).encode()
            if b"".join([self.a_bytes[i] for i in x]) != whole or w and b"".join([self.b_bytes[i] for i in y]) != whole:
                self.odd.add(w)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Packed ids of both sides for each text; none if its bytes don't come back."""
        cut = [[] if not t else BETWEEN.split(t) if UNEVEN.search(t) else t.split(" ") for t in texts]
        new = {w for words in cut for w in words}.difference(self.a_words)
        if len(self.a_words) + len(new) > WORDS:
            self.a_words.clear(), self.b_words.clear(), self.odd.clear()
            new = {w for words in cut for w in words}
        self.learn(list(new))
        for t, words in zip(texts, cut, strict=True):
            a, b = b"".join(map(self.a_words.__getitem__, words)), b"".join(map(self.b_words.__getitem__, words))
            if self.odd and not self.odd.isdisjoint(words) and not self._same(" " + t, a, b):
                a = b = b""
            yield a, b
        for w in new:
            if len(w) > LONG:
                del self.a_words[w], self.b_words[w]
                self.odd.discard(w)

    def _same(self, whole: str, a: bytes, b: bytes) -> bool:
        joined = lambda ids, raw: b"".join([raw[i] for i in np.frombuffer(ids, np.uint32).tolist()])
        return joined(a, self.a_bytes) == joined(b, self.b_bytes) == whole.encode()


_held: dict[tuple[str, str], Tokenizers] = {}  # of this worker


def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    key = (a_file, b_file)
    if key not in _held:
        _held.clear()
        _held[key] = Tokenizers(a_file, b_file)
    return _held[key]


def _packed(values: np.ndarray) -> bytes:
    """Little-endian 32-bit numbers, their bytes by place, compressed."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, n * 4, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()


def _cut(batches: Iterator[pa.RecordBatch], sizes_of, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose sizes sum up to about `most`, or of one row."""
    for batch in batches:
        sizes, start = np.cumsum(sizes_of(batch).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most)))
            yield batch.slice(start, end - start)
            start = end


def _events(a_file: str, b_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_file, b_file)
        for part in _cut(batches, lambda x: pc.binary_length(x.column("text")), SLICE):
            place, offsets, sides, sizes, ids = [], [], [], [], []
            for k, sides_of in enumerate(t.encode(part.column("text").to_pylist())):
                for side, (packed, size) in enumerate(zip(sides_of, (t.a_size, t.b_size), strict=True)):
                    x, at = np.frombuffer(packed, np.uint32), 0
                    for i in range(0, max(1, len(x)), BLOCK):  # a text without tokens has a row too
                        block = x[i : i + BLOCK]
                        place.append(k), offsets.append(at), sides.append(side), sizes.append(len(block)), ids.append(_packed(block))
                        at += int(size[block].sum())
            columns = [part.column("row").take(pa.array(place)), pa.array(offsets, pa.int64()), pa.array(sides, pa.int32()), pa.array(sizes, pa.int32()), pa.array(ids, pa.binary()), part.column("doc_id").take(pa.array(place))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "offset", "side", "n", "ids", "doc_id"])

    return run


def events(df: DataFrame, a_file: str, b_file: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The union of both sides' end events, a row for each text, side and block of BLOCK tokens."""
    limit_batches(df.sparkSession)
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return docs.mapInArrow(_events(a_file, b_file), f"{EVENTS}, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


@dataclass
class Closed:
    """What a stretch of events closed. Links and tokens are in order of bytes; documents by their place in the stretch."""

    a: np.ndarray  # ids of the tokens of all closed groups
    b: np.ndarray
    a_doc: np.ndarray
    b_doc: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    a_last: np.ndarray  # of its group
    b_last: np.ndarray
    ends: np.ndarray  # of groups, in bytes from the stretch's begin
    link_a: np.ndarray  # place of each link's token in a
    link_b: np.ndarray


def swept(a: np.ndarray, a_doc: np.ndarray, b: np.ndarray, b_doc: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> Closed:
    """Merges the ends of two streams of tokens over the same bytes, up to the last end that both share."""
    a_end, b_end = np.cumsum(a_size[a], dtype=np.int64), np.cumsum(b_size[b], dtype=np.int64)
    kind = np.zeros(int(max(a_end[-1] if len(a) else 0, b_end[-1] if len(b) else 0)) + 1, np.uint8)
    kind[a_end] = 1
    kind[b_end] += 2
    at = np.flatnonzero(kind)
    kind = kind[at]
    both = np.flatnonzero(kind == 3)
    done = int(both[-1]) + 1 if len(both) else 0
    at, kind = at[:done], kind[:done]
    of_a, of_b, closes = (kind & 1).astype(bool), (kind & 2).astype(bool), kind == 3
    before_a, before_b, group = (np.cumsum(x) - x for x in (of_a, of_b, closes))
    n_a, n_b = int(of_a.sum()), int(of_b.sum())
    return Closed(a[:n_a], b[:n_b], a_doc[:n_a], b_doc[:n_b], group[of_a], group[of_b], closes[of_a], closes[of_b], at[closes], before_a, before_b)


DIGITS = 7


def _decimal(n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number below n its digits in the low bytes of eight, and how many they are."""
    text = [str(i) for i in range(n)]
    return np.array([int.from_bytes(t.encode(), "little") for t in text], np.uint64), np.array([len(t) for t in text], np.int64)


def described(c: Closed, n_docs: int, decimal: np.ndarray, width: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` for each document of the stretch, empty where it closed nothing."""
    n_groups = len(c.ends)
    b_before = np.concatenate(([0], np.cumsum(np.bincount(c.b_group, minlength=n_groups))))
    a_upto = np.cumsum(np.bincount(c.a_group, minlength=n_groups))
    at_a, at_b = np.arange(len(c.a)) + b_before[c.a_group], np.arange(len(c.b)) + a_upto[c.b_group]
    sign = lambda x: np.uint64(ord(x) << 8 * DIGITS)
    out, sizes = np.zeros(len(c.a) + len(c.b), np.uint64), np.zeros(len(c.a) + len(c.b), np.int64)
    out[at_a] = decimal[c.a] | np.where(c.a_last, sign("|"), sign(","))
    out[at_b] = decimal[c.b] | np.where(c.b_last, sign(";"), sign(","))
    sizes[at_a], sizes[at_b] = width[c.a] + 1, width[c.b] + 1
    flat = out.astype("<u8").view(np.uint8)
    flat = flat[flat != 0].tobytes()
    doc = np.cumsum(np.bincount(c.a_doc, minlength=n_docs) + np.bincount(c.b_doc, minlength=n_docs))
    ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], doc))].tolist()
    return [flat[x : y - 1] if y > x else b"" for x, y in zip(ends[:-1], ends[1:], strict=True)]


class Machine:
    """Streams rows of events, sorted by row, offset and side. State: the open tokens of one document, and what `add` sums for it."""

    def __init__(self, t: Tokenizers):
        self.t, self.row, self.doc_id = t, None, None
        self.open_a = self.open_b = np.zeros(0, np.uint32)

    def stretches(self, batch: pa.RecordBatch) -> tuple[Closed, list[int], list]:
        """What a batch of rows closes, with the documents of the stretch. The first may have begun before, the last may go on."""
        rows, sides, n = batch.column("row").to_pylist(), batch.column("side").to_pylist(), batch.column("n").to_pylist()
        ids, doc_ids = batch.column("ids").to_pylist(), batch.column("doc_id").to_pylist()
        docs, names, place, parts = [], [], [], ([], [])
        if self.row is not None:
            docs, names = [self.row], [self.doc_id]
            parts[0].append((self.open_a, 0)), parts[1].append((self.open_b, 0))
        for r, side, k, x, name in zip(rows, sides, n, ids, doc_ids, strict=True):
            if not docs or docs[-1] != r:
                docs.append(r), names.append(name)
            if k:
                parts[side].append((_unpacked(x, k), len(docs) - 1))
        (a, a_doc), (b, b_doc) = ((np.concatenate([np.zeros(0, np.uint32), *(x for x, _ in p)]), np.repeat(np.array([d for _, d in p], np.int64), [len(x) for x, _ in p])) for p in parts)
        c = swept(a, a_doc, b, b_doc, self.t.a_size, self.t.b_size)
        self.row, self.doc_id, self.open_a, self.open_b = docs[-1], names[-1], a[len(c.a) :], b[len(c.b) :]
        if (len(c.a) < len(a) and a_doc[len(c.a)] != len(docs) - 1) or (len(c.b) < len(b) and b_doc[len(c.b)] != len(docs) - 1):
            raise ValueError("the two sides of a text differ in bytes")
        return c, docs, names


def _sorted(found: DataFrame) -> DataFrame:
    return found.repartition("row").sortWithinPartitions("row", "offset", "side")


def groups(df: DataFrame, a_file: str, b_file: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, start, stop (bytes of space+text), a_ids and b_ids of each group of each text of df.

    row numbers the rows of df, so texts of equal or null ids stay apart. Texts without tokens (see align) have no groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, upto = tokenizers(a_file, b_file), 0
        m = Machine(t)
        for batch in _cut(batches, lambda x: x.column("n"), TOKENS):
            was = m.row
            c, docs, names = m.stretches(batch)
            if not len(c.ends):
                upto = upto if docs[-1] == was else 0
                continue
            of = c.a_doc[c.a_last]
            starts = np.concatenate(([0], c.ends[:-1]))
            first = np.concatenate(([True], of[1:] != of[:-1]))  # a document's first group begins at its byte 0
            base = np.repeat(starts[first], np.diff(np.concatenate((np.flatnonzero(first), [len(of)]))))
            base = base - np.where(of == 0, upto if docs[0] == was else 0, 0)
            begins = [np.concatenate(([0], np.cumsum(np.bincount(x, minlength=len(c.ends))))) for x in (c.a_group, c.b_group)]
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(x.astype(np.int32))) for o, x in zip(begins, (c.a, c.b), strict=True)]
            kind = batch.schema.field("doc_id").type
            yield pa.RecordBatch.from_arrays([pa.array(np.array(docs)[of]), pa.array([names[d] for d in of], kind), pa.array(starts - base), pa.array(c.ends - base), *lists], ["row", "doc_id", "start", "stop", "a_ids", "b_ids"])
            upto = int(c.ends[-1] - base[-1]) if of[-1] == len(docs) - 1 else 0

    found = events(df, a_file, b_file, doc_id=doc_id, text=text)
    return _sorted(found).mapInArrow(run, f"row long, doc_id {found.schema['doc_id'].dataType.simpleString()}, start long, stop long, a_ids array<int>, b_ids array<int>")


def _summaries(a_file: str, b_file: str):
    """For each document its counts, the hash of its groups, and its distinct pairs with their numbers of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_file, b_file)
        m, (decimal, width) = Machine(t), _decimal(max(t.n_a, t.n_b))
        sums, digest, pairs = np.zeros(4, np.int64), None, []  # of the document that may go on
        kind = None

        def finished(rows: list, names: list, counts: list, hashes: list, held: list) -> pa.RecordBatch:
            keys, times = zip(*held, strict=True)
            columns = [pa.array(rows, pa.int64()), pa.array(names, kind), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(hashes, pa.string()), pa.array([len(k) for k in keys], pa.int32())]
            columns += [pa.array([_packed(np.concatenate((k // t.n_b, k % t.n_b))) for k in keys], pa.binary()), pa.array([_packed(x) for x in times], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pairs", "times"])

        def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *(k for k, _ in held)]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([np.zeros(0), *(x for _, x in held)]), len(keys)).astype(np.int64)

        for batch in _cut(batches, lambda x: x.column("n"), TOKENS):
            kind, was, was_name = batch.schema.field("doc_id").type, m.row, m.doc_id
            c, docs, names = m.stretches(batch)
            n = len(docs)
            text = described(c, n, decimal, width)
            link_doc = c.a_doc[c.link_a]
            counts = np.stack([np.bincount(x, minlength=n) for x in (c.a_doc, c.b_doc, c.a_doc[c.a_last], link_doc)], 1)
            span = t.n_a * t.n_b
            keys, times = np.unique(link_doc * span + c.a[c.link_a].astype(np.int64) * t.n_b + c.b[c.link_b], return_counts=True)
            edges = np.searchsorted(keys, np.arange(n + 1) * span).tolist()
            keys = keys - np.repeat(np.arange(n) * span, np.diff(edges))
            out = ([], [], [], [], [])
            for d in range(n):
                own = (keys[edges[d] : edges[d + 1]], times[edges[d] : edges[d + 1]])
                if d == 0 and docs[0] == was:
                    sums = sums + counts[0]
                    pairs.append(own)
                else:
                    sums, pairs, digest = counts[d], [own], None
                if text[d]:
                    if digest is None:
                        digest = hashlib.sha256(text[d])
                    else:
                        digest.update(b";" + text[d])
                if d < n - 1:
                    for x, v in zip(out, (docs[d], names[d], sums.tolist(), digest.hexdigest() if digest else "", pairs[0] if len(pairs) == 1 else merged(pairs)), strict=True):
                        x.append(v)
                elif len(pairs) > 50:
                    pairs = [merged(pairs)]
            if out[0]:
                yield finished(*out)
        if m.row is not None:
            yield finished([m.row], [m.doc_id], [sums.tolist()], [digest.hexdigest() if digest else ""], [merged(pairs)])

    return run


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair as a 64-bit number, times, row of the batch) of all documents of a batch."""
    n = batch.column("n_pairs").to_pylist()
    pairs = [_unpacked(x, 2 * k).reshape(2, k).astype(np.int64) if k else np.zeros((2, 0), np.int64) for x, k in zip(batch.column("pairs").to_pylist(), n, strict=True)]
    times = [_unpacked(x, k) if k else np.zeros(0, np.uint32) for x, k in zip(batch.column("times").to_pylist(), n, strict=True)]
    both = np.concatenate([np.zeros((2, 0), np.int64), *pairs], 1)
    return (both[0] << 32) | both[1], np.concatenate([np.zeros(0, np.uint32), *times]).astype(np.int64), np.repeat(np.arange(len(n)), n)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each pair in a task's documents."""

    def summed(keys: list, times: list) -> tuple[np.ndarray, np.ndarray]:
        k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(inverse, np.concatenate(times), len(k)).astype(np.int64)  # doubles are exact here

    def rows(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["pair", "n"])

    keys, times, new = [], [], 0
    for batch in _cut(batches, lambda x: x.column("n_pairs"), TOKENS):
        k, x, _ = _keys(batch)
        keys.append(k), times.append(x)
        new += len(k)
        if new > FLUSH:
            k, x = summed(keys, times)
            if len(k) > FLUSH:
                yield rows(k, x)
                keys, times, new = [], [], 0
            else:
                keys, times, new = [k], [x], 0
    if keys:
        yield rows(*summed(keys, times))


def _met(hot):
    """Sums over the links of hot pairs, and the other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = hot.value
        for batch in _cut(batches, lambda x: x.column("n_pairs"), TOKENS):
            keys, times, of = _keys(batch)
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            n, total, top = batch.num_rows, np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, of[hit], counts[at[hit]] * times[hit])
            np.add.at(top, of[hit], times[hit] * best[at[hit]])
            ends = np.concatenate(([0], np.cumsum(np.bincount(of[~hit], minlength=n))))
            rest = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[~hit])) for x in (keys, times)]
            columns = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(top), pa.array(total), *rest], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rest", "times"])

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    """As stored(), for columns that are compressed already."""
    at = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def pair_counts(summaries: DataFrame) -> DataFrame:
    """pair (a_id * 2^32 + b_id), n (its links in the corpus) and is_best (no pair of its B id has more)."""
    counts = summaries.select("n_pairs", "pairs", "times").mapInArrow(_tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = _written(counts.withColumn("b_id", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pairs")
    top = counts.groupBy("b_id").agg(F.max("n").alias("top"))
    return _written(counts.join(top, "b_id").select("pair", "n", (F.col("n") == F.col("top")).alias("is_best")), "counts")


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The pairs of the highest counts, at most `most`: down to the step of counts, of two percent each, that still fits."""
    step = F.floor(F.log(F.col("n").cast("double")) * 50)
    sizes = {r["step"]: r["size"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("size")).collect()}  # some hundred rows
    least, total = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        least = k
    return counts.filter(step >= least)


def align(df: DataFrame, a_file: str, b_file: str, *, doc_id: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for each row of df.

    n_best counts the links whose pair of ids is linked as often in the corpus as any pair of its B id; count_sum sums
    the corpus-wide counts of the pairs over the links. groups_sha256 hashes the groups as `a1,a2|b1;a3|b2,b3`, without tokens it
    is ''. A text that is null or empty, or whose bytes one side doesn't give back (a space mark in a text comes back as a
    space), has no tokens: zeros. Strings of special tokens are ordinary text. Null ids and repeated rows stay. An
    empty table gives no rows. Other columns of df aren't read. Files are paths that every executor can open. `hot`
    pairs are broadcast; it changes no result.
    """
    spark = df.sparkSession
    found = events(df, a_file, b_file, doc_id=doc_id, text=text)
    kind = found.schema["doc_id"].dataType.simpleString()
    plain = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    summaries = _written(_sorted(found).mapInArrow(_summaries(a_file, b_file), f"{plain}, n_pairs int, pairs binary, times binary"), "alignments")
    counts = pair_counts(summaries)
    top = _frequent(counts, hot).toArrow()  # at most `hot` rows of three numbers
    keys, n, best = (top.column(c).to_numpy() for c in ("pair", "n", "is_best"))
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((keys[order], n[order], best[order].astype(np.int64)))
    met = _written(summaries.mapInArrow(_met(sent), f"{plain}, n_best long, count_sum long, rest array<bigint>, times array<bigint>"), "met")
    others = met.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.times").alias("k"))
    sums = others.join(counts, "pair").groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("more"), F.sum(F.when(F.col("is_best"), F.col("k")).otherwise(0)).alias("more_best"))
    out = met.drop("rest", "times").join(sums, "row", "left")
    added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}
    return out.withColumns(added).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

"""Near-duplicate groups by SimHash: fingerprints of 64 bits that differ in at most three.

1. A fingerprint: the XXH64 (seed 42) of each run of three words; a bit is set if over half the hashes set it.
   Documents of one fingerprint are one class; only classes go on, so copies cost nothing more.
2. Inverted index by byte position. Three differing bits touch at most three of the eight bytes, so a pair to find
   shares five positional bytes or more, and three of them in one half. Lists are kept under three positional bytes of
   one half, four to a half: with a list for each single byte every class would meet one of 32 others. In
   a list the shared positional bytes of each pair are tallied; pairs with five or more are verified bit by bit.
3. A list of more than PART members is dealt anew under two more positional bytes, all ten choices of two of the
   other five, since a pair shares two of them too. Lists that are still longer go through hubs: a class posts itself
   under fingerprints near to it, so that two classes within three bits meet under one that is within one bit of the
   first and two of the second. A hub has at most 2,081 members, whatever is posted; one within a bit of it is linked
   with all. No list is capped or dropped, and none is worked on whole.
4. A list hands on links that connect what its pairs connect, not all its pairs. Components by alternating
   large-star and small-star steps, in tables of the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import limit_batches, stored
from orrery.llm.near_dup import components

SEED = 42
BITS = 3  # in which linked fingerprints may differ
LEAST = 8 - BITS  # positional bytes that they share at least
PART = 4096  # members of a list that one task compares
SHORT = 16  # members of a list that are compared with each of the next ones, many lists at a time
SLICE = 2_000_000  # bytes of text taken together in a task
TERMS = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]  # of positions


def fingerprints_of(texts: list[str], words: int) -> np.ndarray:
    """The fingerprint of each text, unsigned."""
    import xxhash

    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for t in texts:
        found = t.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
        if len(found) > words:
            joined, ends = b" ".join(found), list(accumulate(len(w) + 1 for w in found))
            own = [digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]
        else:
            own = [digest(b" ".join(found), SEED)] if found else []
        hashes += own
        sizes.append(len(own))
    size = np.array(sizes, np.int64)
    ends, set_bits = np.cumsum(size), np.zeros((len(texts), 64), np.int64)
    h = np.array(hashes, np.uint64)
    some = np.flatnonzero(size)
    for i in range(0, len(some), 64):  # a few documents at a time: 64 numbers for each hash
        of = some[i : i + 64]
        lo, hi = int(ends[of[0]] - size[of[0]]), int(ends[of[-1]])
        bits = np.unpackbits(h[lo:hi].astype(">u8").view(np.uint8)).reshape(-1, 64)
        set_bits[of] = np.add.reduceat(bits, ends[of] - size[of] - lo, axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > size[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprinter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, start = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)), 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE)))
                part = batch.slice(start, end - start)
                found = fingerprints_of(part.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "mark"])
                start = end

    return run


def fingerprints(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """doc_id and mark, the fingerprint as a signed 64-bit number, for each row of df; 0 for texts without words."""
    limit_batches(df.sparkSession)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return docs.mapInArrow(_fingerprinter(words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long")


def _byte(mark: Column, position: int) -> Column:
    return F.shiftright(mark, 56 - 8 * position).bitwiseAND(255)


def _term(mark: Column, positions: tuple[int, ...], nth: int) -> Column:
    """The positional bytes as one number, with the number of their choice of positions."""
    out = F.lit(nth).cast("long")
    for p in positions:
        out = out * 256 + _byte(mark, p)
    return out


def _tally(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs that share LEAST positional bytes or more and, verified, differ in at most BITS bits."""
    differ = x ^ y
    shared = (np.ascontiguousarray(differ).view(np.uint8).reshape(-1, 8) == 0).sum(1)
    near = shared >= LEAST
    near[near] = np.bitwise_count(differ[near]) <= BITS
    return near


def _joined(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs of one list connect: each member is found once, from one that was found before."""
    u, v, left = [], [], members
    while len(left):
        found, left = [left[0]], left[1:]
        while found and len(left):
            x = found.pop()
            near = _tally(left, np.full(len(left), x))
            if near.any():
                u.append(np.full(int(near.sum()), x)), v.append(left[near])
                found.extend(left[near])
                left = left[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of lists that come one after the other (sorted by term); the last list of a batch waits for its end."""

    def found(term: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        begins = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((begins, [len(term)])))
        u, v = [], []
        short = np.repeat(sizes <= SHORT, sizes)
        t, m = term[short], mark[short]
        for k in range(1, int(sizes[sizes <= SHORT].max(initial=1))):
            same = np.flatnonzero(t[k:] == t[:-k])
            near = _tally(m[same], m[same + k])
            u.append(m[same[near]]), v.append(m[same[near] + k])
        for b, n in zip(begins[sizes > SHORT], sizes[sizes > SHORT], strict=True):
            x, y = _joined(mark[b : b + n])
            u.append(x), v.append(y)
        none = np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x]).view(np.int64)) for x in (u, v)], ["u", "v"])

    term, mark = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        term = np.concatenate((term, batch.column("term").to_numpy()))
        mark = np.concatenate((mark, batch.column("mark").to_numpy().view(np.uint64)))
        done = int(np.searchsorted(term, term[-1]))
        if done:
            yield found(term[:done], mark[:done])
            term, mark = term[done:], mark[done:]
    if len(term):
        yield found(term, mark)


def _compared(postings: DataFrame) -> DataFrame:
    return postings.repartition("term").sortWithinPartitions("term").mapInArrow(_links, "u long, v long")


def _by_length(postings: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    """Postings (term, mark) of lists of up to `part` members, and those of longer ones."""
    long = stored(postings.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") > part).select("term"), "long")
    if long.isEmpty():
        return postings, postings.limit(0)
    return postings.join(long, "term", "left_anti"), stored(postings.join(long, "term"), "postings")


def _hubs(marks: DataFrame) -> DataFrame:
    """Links of marks (mark, distinct) that connect all within BITS bits, by what lies between them.

    Two marks of one parity differ in two bits and meet one bit from both; of two parities, they differ in one or
    three, and the even one posts under those two bits away, the odd one under itself and those one bit away.
    """
    one = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
    two = "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) ^ shiftleft(1L, j))))"
    even = F.bit_count("mark") % 2 == 0
    near = F.when(even, F.expr(one)).otherwise(F.concat(F.array(F.lit(0).cast("long")), F.expr(one)))
    posted = marks.select("mark", F.explode(near).alias("flip"), F.lit(True).alias("near"))
    posted = posted.unionByName(marks.filter(even).select("mark", F.explode(F.expr(two)).alias("flip"), F.lit(False).alias("near")))
    posted = posted.select("mark", "near", F.col("mark").bitwiseXOR(F.col("flip")).alias("hub"))
    center = F.min(F.when(F.col("near"), F.col("mark"))).over(Window.partitionBy("hub"))  # over at most 2,081 rows
    return posted.withColumn("center", center).filter("center <> mark").select(F.col("center").alias("u"), F.col("mark").alias("v")).distinct()


def links(marks: DataFrame, part: int = PART) -> DataFrame:
    """u and v, marks that differ in at most BITS bits; they connect all marks (distinct) that such pairs connect."""
    mark = F.col("mark")
    terms = F.array(*[_term(mark, c, i) for i, c in enumerate(TERMS)])
    short, long = _by_length(marks.select("mark", F.explode(terms).alias("term")), part)
    out = [_compared(short)]
    if not long.isEmpty():
        nth = F.shiftright("term", 24)
        more = F.lit(None)
        for i, c in enumerate(TERMS):
            others = [p for p in range(8) if p not in c]
            more = F.when(nth == i, F.array(*[F.col("term") * 2**20 + _term(mark, d, k) for k, d in enumerate(combinations(others, 2))])).otherwise(more)
        short, long = _by_length(long.select("mark", F.explode(more).alias("term")), part)
        out += [_compared(short)]
        if not long.isEmpty():
            out += [_hubs(long.select("mark").distinct())]
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return stored(found, "links")


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, part: int = PART) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id for each row of df.

    Words are runs of non-white-space with A-Z lower-cased; fewer than `words` of them are one shingle, and a text
    without words (null, empty, white space) has fingerprint zero, linked like any other. Fingerprints that differ in at
    most BITS bits are linked. component_id is the least id that links reach; null ids are passed over, and it is null
    where no document has an id. Ids are of any type that has an order. Repeated rows are all returned. An empty table gives no
    rows. Other columns of df aren't read. `part` changes no result.
    """
    rows = stored(fingerprints(df, doc_id=doc_id, text=text, words=words), "fingerprints")
    classes = stored(rows.groupBy("mark").agg(F.min("doc_id").alias("least_id")), "classes")
    labels = stored(components(links(classes.select("mark"), part)), "components")
    of_class = classes.join(labels.hint("merge"), classes["mark"] == labels["node"], "left").select("mark", "least_id", "component")
    joined = of_class.filter("component IS NOT NULL")
    of_component = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = joined.join(of_component.hint("merge"), "component").select("mark", "component_id")
    named = named.unionByName(of_class.filter("component IS NULL").select("mark", F.col("least_id").alias("component_id")))
    out = rows.join(named.hint("merge"), "mark")
    return out.select("doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id")

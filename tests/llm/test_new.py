"""The conversation trie, SimHash groups and the alignment of tokenizers against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from orrery.llm import alignment, oracles, prefix_trie, queries, simhash

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

# The trie.

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    for c in convs.values():
        c.sort()
    whole, members, children = {}, defaultdict(list), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = [(x[2], x[4]) for x in convs.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h] + own[h:]]
        for k in range(len(whole[c]) + 1):
            members[tuple(whole[c][:k])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    rnd, rows = random.Random(7), []
    texts = ["", "hello", "hello there", "ünï 🙂", "a" * 500, "what now", "b c"]
    for c in [*range(330), *range(500, 560), -250, -200, -199, 10**15, 10**15 + 3]:
        if c == 300:  # a block without its first conversation
            continue
        for turn in range(rnd.choice([1, 2, 3, 5, 8])):
            rows.append((c, turn if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant", None]), rnd.choice(texts)))
        if c % 17 == 0:
            rows.append(rows[-1])  # a repeated row
        if c % 23 == 0:
            rows.append((c, 0, "user", "a second turn of this number"))
    for c in range(1000, 1100):  # a hot group: all alike but one long conversation
        rows += [(c, t, "user", "the same") for t in range(8)]
    rows += [(1050, t, "user", f"turn {t}") for t in range(8, 300)]
    rows += [(None, 1, "user", "of no conversation"), (7, 9, None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("partitions", "held", "piece"), [(1, 20_000, 50_000), (7, 2, 3), (90, 1, 1)])
def test_trie(spark, monkeypatch, partitions, held, piece):
    monkeypatch.setattr(prefix_trie, "HELD", held)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rows, before = conversations(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, size int").repartition(5)
        got = prefix_trie.conversation_trie(df).select(*TRIE).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got), key=str) == trie_of(rows)


def test_trie_sweeps_in_many_ranges(spark):
    """Stitching by itself: sweeps over any cuts of the sorted keys, in small pieces."""
    rnd = random.Random(3)
    turns = {t: hashlib.md5(t.encode()).digest() for t in "abc"}
    convs = sorted((b"".join(turns[t] for t in s), i, [ord(t) for t in s]) for i, s in enumerate("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 5))) for _ in range(400)))
    want = None
    for cuts in (0, 1, 9, 80, 399):
        edges = [0, *sorted(rnd.sample(range(1, 400), cuts)), 400]
        rows = []
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            s = prefix_trie.Sweep(k)
            for key, i, sizes in convs[a:b]:
                s.add(key, sizes, i)
            s.finish()
            rows += s.taken().to_pylist()
        fragments = sorted((r for r in rows if r["kind"] == prefix_trie.OPEN), key=lambda r: (r["range"], r["path"], -r["depth"], r["piece"]))
        import pyarrow as pa

        batch = pa.RecordBatch.from_pylist(fragments, pa.schema([(n, t) for n, t, _ in prefix_trie.FIELDS]))
        rows += [r for b in prefix_trie._stitched(iter([batch])) for r in b.to_pylist()]
        named = {r["prefix"]: r["conv_id"] for r in rows if r["kind"] == prefix_trie.NAMED}
        nodes = [r | ({"parent_conv_id": named[r["prefix"]]} if r["kind"] == prefix_trie.PENDING else {}) for r in rows if r["kind"] in (prefix_trie.NODE, prefix_trie.PENDING)]
        got = sorted((tuple(r[c] for c in TRIE) for r in nodes), key=str)
        want = want or got
        assert got == want and len(got) > 150


def test_trie_odd(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(none).count() == 0
    # of conversation 1 the first 5 turns would come from the absent 0, so it ends at the root without turns
    assert zlib.crc32(b"1") % 6 > 1
    got = prefix_trie.conversation_trie(spark.createDataFrame([(1, None, None, None), (1, 2, "user", "x")], none.schema)).select(*TRIE).collect()
    assert list(map(tuple, got)) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_trie_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{at}/conversations.parquet'")
    want = con.sql(oracles.SQL["op11_prefix_trie"]).project(", ".join(TRIE)).fetchall()
    assert sorted(map(tuple, queries.op11_prefix_trie(spark, at).select(*TRIE).collect()), key=str) == sorted(map(tuple, want), key=str)


# SimHash.


def mark_of(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in ([w[i : i + 3] for i in range(len(w) - 2)] or ([w] if w else []))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(marks, bits=3):
    root = {m: m for m in marks}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    arr = np.array(sorted(root), np.uint64)
    for i, m in enumerate(arr):
        for j in np.flatnonzero(np.bitwise_count(arr[:i] ^ m) <= bits):
            root[find(int(m))] = find(int(arr[j]))
    return {m: find(m) for m in marks}


@pytest.mark.parametrize("part", [4096, 20, 3, 0])
def test_simhash_links(spark, part):
    """Clusters of marks that chain at three bits: all lists, lists under five bytes, hubs."""
    rnd, marks = random.Random(part), {0, 2**64 - 1, 7, 15, 2**63}
    for _ in range(5):
        base = rnd.getrandbits(64)
        for _ in range(120):
            m = base
            for _ in range(rnd.randint(0, 5)):
                m ^= 1 << rnd.randrange(64)
            marks.add(m)
    signed = [(int(np.uint64(m).view(np.int64)),) for m in sorted(marks)]
    found = [(r.u % 2**64, r.v % 2**64) for r in simhash.links(spark.createDataFrame(signed, "mark long"), part).collect()]
    assert all((u ^ v).bit_count() <= 3 for u, v in found)
    root = {m: m for m in marks}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    for u, v in found:
        root[find(u)] = find(v)
    groups = lambda of: sorted(sorted(m for m in marks if of[m] == r) for r in set(of.values()))
    want = groups(components_of(marks))
    assert groups({m: find(m) for m in marks}) == want and 20 < len(want) < len(marks)


def near_texts():
    rnd = random.Random(11)
    vocabulary, out = [f"W{i}" for i in range(300)], []
    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 400))]
        for _ in range(rnd.randint(1, 8)):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary).lower()
            out.append(rnd.choice([" ", "\n", " \t "]).join(w))
    return out


@pytest.mark.parametrize("as_text", [False, True])
def test_simhash(spark, odd, none, as_text):
    name = (lambda i: f"d{i:05}") if as_text else (lambda i: i)
    rows = [(name(i), t) for i, t in enumerate([*near_texts(), None, "", " \x0b\n", "one", "ONE", "two words"])] + [(None, "one"), (None, "alone without id"), (name(3), "another text of this id")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, f"doc_id {'string' if as_text else 'long'}, text string").repartition(4)).collect()
    marks = [mark_of(t) for _, t in rows]
    of, least = components_of(set(marks)), {}
    for (i, _), m in zip(rows, marks, strict=True):
        if i is not None:
            least[of[m]] = min(i, least.get(of[m], i))
    assert Counter(map(tuple, got)) == Counter((i, f"{m:016x}", least.get(of[m])) for (i, _), m in zip(rows, marks, strict=True))
    assert sum(least.get(of[m]) != i for (i, _), m in zip(rows, marks, strict=True)) > 50
    odd_rows = simhash.near_duplicates(odd).collect()
    assert len(odd_rows) == odd.count() and {r.component_id for r in odd_rows if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_duplicates(none).count() == 0


# Alignment.


def aligned(texts):
    """Per text the groups and links by walking both sides token by token; corpus-wide counts of pairs."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_of, b_of, t = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.Tokenizers(A, B)
    a_of.encode_special_tokens = True
    out, counts, best = [], Counter(), defaultdict(int)
    for text in texts:
        a, b = (a_of.encode(" " + text, add_special_tokens=False).ids, b_of.encode(text)) if text else ([], [])
        sides = [[raw[i] for i in ids] for ids, raw in ((a, t.a_bytes), (b, t.b_bytes))]
        if not text or any(b"".join(x) != (" " + text).encode() for x in sides):
            out.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in sides]
        shared, groups, links, i, j = sorted(set(ends[0]) & set(ends[1])), [], [], 0, 0
        for end in shared:
            x, y = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        spans = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
        for k, (s, e) in enumerate(spans[0]):
            links += [(a[k], b[m]) for m in range(np.searchsorted(ends[1], s, "right"), np.searchsorted(ends[1], e, "left") + 1)]
        out.append((a, b, groups, links))
        counts.update(links)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = []
    for a, b, groups, links in out:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return rows, out


def texts_of():
    rnd = random.Random(2)
    odd = [
        None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "x\n y", "x\n  y", "x \n y ", "tab\tand  two", "it's we'll don't 's", "naïve Straße 日本語 🙂🙂 x", "▁", "a▁b c", "<s> </s> <|endoftext|> <0x41>", "\x00 \x01", "  x y", "\x1c a\x1c b", "12345 6.7e8 !!??",
        "x" * 300, "<unk>", "​ z", "é é",
    ]
    letters = "abcde  \n\t'.,é日🙂1 "
    return odd + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 120))) for _ in range(150)] + [" ".join(rnd.choice(["the", "token", "alignments", "of", "Wörter", "unbelievable"]) for _ in range(3_000))]


@pytest.mark.parametrize(("block", "tokens", "hot", "words"), [(16_384, 1_000_000, 1_000_000, 300_000), (7, 50, 10, 20), (3, 1, 0, 1)])
def test_alignment(spark, monkeypatch, block, tokens, hot, words):
    for name, value in (("BLOCK", block), ("TOKENS", tokens), ("WORDS", words), ("FLUSH", tokens)):
        monkeypatch.setattr(alignment, name, value)
    texts = texts_of()
    want, parts = aligned(texts)
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, row int, ids string").repartition(3)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.doc_id: tuple(r[c] for c in columns) for r in alignment.align(df, A, B, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == want and sum(not w[0] for w in want) >= 4
    found = defaultdict(list)
    for r in alignment.groups(df, A, B).orderBy("row", "start").collect():
        found[r.doc_id].append((r.a_ids, r.b_ids, r.start, r.stop))
    for i, (_, _, groups, _) in enumerate(parts):
        assert [(x, y) for x, y, _, _ in found[i]] == groups
        assert all(p[3] == q[2] for p, q in zip(found[i], found[i][1:], strict=False)) and (not groups or found[i][0][2] == 0 and found[i][-1][3] == len((" " + texts[i]).encode()))


def test_alignment_odd(odd, none):
    got = alignment.align(odd, A, B).collect()
    assert len(got) == odd.count() and all(r.n_a == 0 and r.groups_sha256 == "" for r in got if r.doc_id in (1, 2))
    assert len({tuple(r) for r in got if r.doc_id == 6}) == 1 and all(r.n_links == r.n_a + r.n_b - r.n_groups for r in got)
    assert alignment.align(none, A, B).count() == 0 and alignment.groups(none, A, B).count() == 0


def test_alignment_refuses_other_models():
    with pytest.raises(ValueError, match="byte-level"):
        alignment.Tokenizers(public_tokenizers.path("word_bpe_49k.json"), B)

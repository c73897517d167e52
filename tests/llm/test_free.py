"""Near-dedup, token counts, SentencePiece, search and the trained scorers against brute force and held-out rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orrery.llm import bm25_search, near_dup, quality_rules, sentence_pieces, token_counts, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def shingle_set(t, n):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def groups(rows, n, percent=80):
    """Least id reachable, by comparing all pairs."""
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return {i: least.get(find(i)) for i in range(len(rows))}, sets


def near_rows():
    rnd, rows = random.Random(5), []
    vocabulary = [f"v{i}" for i in range(400)]
    passage = " ".join(rnd.choice(vocabulary) for _ in range(60))
    for g in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, 6)):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary).upper()
            rows.append(" ".join(w) + (" " + passage if g % 3 == 0 else ""))
    template = [rnd.choice(vocabulary) for _ in range(80)]
    for _ in range(90):  # a large group about the threshold
        w = list(template)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"n{rnd.random()}"
        rows.append(" ".join(w))
    for _ in range(60):  # texts of little but a common passage
        rows.append(passage + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 40))))
    rnd.shuffle(rows)
    return [(1000 - 3 * i, t) for i, t in enumerate(rows)] + [(2000 + i, "a b c d e"[: 2 * i + 1]) for i in range(5)] + [(3000, "A b  c\nd e"), (3001, None), (3002, ""), (3003, " ")]


@pytest.mark.parametrize(("words", "small", "part"), [(4, 32, 512), (5, 4, 5)])
def test_near_duplicates(spark, monkeypatch, words, small, part):
    monkeypatch.setattr(near_dup, "SMALL", small)  # so that long lists occur
    monkeypatch.setattr(near_dup, "PART", part)
    rows = near_rows()
    want, sets = groups(rows, words)
    got = {r.doc_id: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), words=words).collect()}
    assert len(got) == len(rows)
    for i, (d, _) in enumerate(rows):
        assert (got[d].n_shingles, got[d].component_id, got[d].kept) == (len(sets[i]), want[i], want[i] == d), d
    assert sum(want[i] != d for i, (d, _) in enumerate(rows)) > 50
    kept = near_dup.deduplicate(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, set_id int"), words=words)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for i, (d, _) in enumerate(rows) if want[i] == d) and kept.columns == ["doc_id", "text", "set_id"]


def test_near_duplicates_odd(odd, none):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5} and all(r.component_id == r.doc_id for r in got if r.doc_id in (1, 2, 3))
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.deduplicate(none).count() == 0
    assert Counter(r.doc_id for r in near_dup.deduplicate(odd).collect()) == Counter([1, 2, 3, 4, 5, 7, 8, 9, None, None])


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(50)]
    df = spark.createDataFrame([(str(a).encode().rjust(4), str(b).encode().rjust(4)) for a, b in edges], "u binary, v binary")
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {int(r.node): int(r.component) for r in near_dup.components(df).collect()}
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}


def texts():
    rnd = random.Random(1)
    alphabet = list(" ab\n▁é🙂<s>\t́ .日本\x00") + ["the", "  ", "ing "]
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(800)]
    return out + ["", " ", "</s><s> <unk>", "▁", "a ▁ b", "the" * 400 + "in" * 300, "x" * 5000, "a" + " " * 70 + "b "]


def test_token_counts(spark):
    model, rows = token_counts.load(MODEL), list(enumerate(texts()))
    got = {r.doc_id: r for r in token_counts.count_tokens(spark.createDataFrame([*rows, (-1, None)], "doc_id int, text string"), MODEL, limit=20).collect()}
    for i, t in rows:
        n = len(model.encode(t))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(t.encode()), n > 20), repr(t)
    assert got[-1].n_tokens == got[-1].n_bytes == 0


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_token_counts_join(spark, monkeypatch, odd, none, hot):
    """Whatever is broadcast, and however often tasks hand on what they hold, counts are the library's."""
    monkeypatch.setattr(token_counts, "FLUSH", 7)
    model, rows = token_counts.load(MODEL), [*enumerate(texts()), (5, "same id"), (5, "same id")]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(df, MODEL, hot=hot).collect())
    assert got == Counter((i, len(model.encode(t))) for i, t in rows)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.count_tokens(odd, MODEL, hot=hot).collect()) == sorted((r.doc_id or 0, len(model.encode(r.text or ""))) for r in odd.collect())
    assert token_counts.count_tokens(none, MODEL, hot=hot).count() == 0


def test_pieces_are_the_librarys(spark, odd, none):
    model, rows = token_counts.load(MODEL), list(enumerate(texts()))
    coded = sentence_pieces.encode(spark.createDataFrame(rows, "doc_id int, text string"), MODEL)
    got = {r.doc_id: r for r in coded.collect()}
    for i, t in rows:
        assert got[i].ids == model.encode(t), repr(t)
        assert got[i].round_trip == ("▁" not in t)
    back = {r.doc_id: r.text for r in sentence_pieces.decode(coded, MODEL).collect()}
    assert all(back[i] == model.decode(got[i].ids) for i, _ in rows)
    assert sentence_pieces.encode(odd, MODEL).filter("round_trip").count() == odd.count() and sentence_pieces.encode(none, MODEL).count() == 0


def brute_viterbi(word, scores):
    best = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        found = [(best[s][0] + scores[word[s:end]], best[s][1] + [word[s:end]]) for s in range(end) if word[s:end] in scores and s in best]
        if found:
            best[end] = max(found, key=lambda x: x[0])
    return best[len(word)][1]


def test_viterbi_for_unigram_models():
    rnd = random.Random(2)
    chars = "abcd▁"
    names = list(dict.fromkeys([*chars, *("".join(rnd.choice(chars[:4]) for _ in range(rnd.randint(2, 5))) for _ in range(60)), "▁a", "▁bc"]))
    scores = {p: -rnd.random() * 9 - 1 for p in names}
    pieces = sentence_pieces.Pieces(["<unk>", *names], [0.0, *scores.values()], bytes_at={}, unknown=0, unigram=True)
    for t in ("abcdabcd", "aab bcdda", "d", "cab" * 9, "a b c d"):
        ids = pieces.encode([t])[0]
        want = [p for w in pieces.words(t) for p in brute_viterbi(w, scores)]
        assert abs(sum(pieces.scores[ids]) - sum(scores[p] for p in want)) < 1e-9 and pieces.decode([ids]) == [t]


def test_search(spark, monkeypatch, odd, none):
    monkeypatch.setattr(bm25_search, "QUERIES", 6)
    monkeypatch.setattr(bm25_search, "BLOCK", 3)
    rnd = random.Random(4)
    rows = [(i, " ".join(f"t{int(rnd.expovariate(0.02))}" for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = defaultdict(list)
    for r in bm25_search.search(df, F.col("doc_id") % 20 == 0, k=5, terms=6).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, round(r.score, 9)))
    docs = {i: Counter(t.split()) for i, t in rows}
    df_, n = Counter(w for c in docs.values() for w in c), len(docs)
    mean = sum(sum(c.values()) for c in docs.values()) / n
    idf = lambda w: np.log(1 + (n - df_[w] + 0.5) / (df_[w] + 0.5))
    import pandas as pd

    key = lambda w: int(pd.util.hash_array(np.array([w], object), categorize=False).view(np.int64)[0])
    for q in range(0, 300, 20):
        terms = sorted((w for w in docs[q] if df_[w] > 1), key=lambda w: (-idf(w), -docs[q][w], key(w)))[:6]
        score = {d: sum(idf(w) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in sorted(terms, key=key) if w in c) for d, c in docs.items()}
        want = sorted(((d, round(s, 9)) for d, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))[:5]
        assert [d for d, _ in got[q]] == [d for d, _ in want]
    assert bm25_search.search(odd, F.col("doc_id").isNotNull()).filter("rank > 10").count() == 0 and bm25_search.search(none, F.lit(True)).count() == 0


def test_search_asks_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(bm25_search, "QUERY_WORDS", 500)
    monkeypatch.setattr(bm25_search, "SHARD_DOCS", 40)
    rnd = random.Random(7)
    rows = [(i, " ".join(f"t{int(rnd.expovariate(0.02))}" for _ in range(rnd.randint(0, 90)))) for i in range(300)]
    rows += [(300, rows[20][1]), (301, rows[20][1]), (320, "alone with nobody else"), (340, "")]  # copies tie; words of one text only
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = {i: Counter(t.split()) for i, t in rows}
    n, mean = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    having = Counter(w for c in docs.values() for w in c)
    idf = {w: np.log(1 + (n - f + 0.5) / (f + 0.5)) for w, f in having.items()}
    got = defaultdict(list)
    for r in bm25_search.search(df, F.col("doc_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, round(r.score, 7)))
    for q in range(0, 341, 20):
        score = {d: sum(idf[w] * m * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, m in docs[q].items() if w in c) for d, c in docs.items()}
        assert got[q] == sorted(((d, round(s, 7)) for d, s in score.items() if s > 0), key=lambda x: (-x[1], x[0]))[:5]
    assert [d for d, _ in got[20]][:3] == [20, 300, 301] and [d for d, _ in got[320]] == [320] and got[340] == []


@pytest.mark.parametrize("dense", [0.0, 0.002, 2.0])  # all words in the product of matrices, some, none
def test_shard_scores_whole_texts(monkeypatch, dense):
    monkeypatch.setattr(bm25_search, "DENSE", dense)
    monkeypatch.setattr(bm25_search, "TOGETHER", 3)
    rnd = np.random.default_rng(1)
    cells = np.where(rnd.random((40, 500)) < rnd.random((40, 1)) ** 3, np.round(rnd.random((40, 500)), 2), 0)
    cells[:, 7] = cells[:, 300]
    cells[:, 8] = 0.5  # each word has a document
    words, docs = np.nonzero(cells)
    shard = bm25_search.Shard(words, docs, cells[words, docs])
    asked = [np.flatnonzero(rnd.random(40) < 0.5) for _ in range(10)]
    edges, flat = np.cumsum([0, *map(len, asked)]), np.concatenate(asked)
    weights = np.round(1 + 3 * rnd.random(len(flat)), 1)
    at = shard.find(flat)
    for i, docs, scores in shard.best(edges, at[at >= 0], weights[at >= 0], np.zeros(10), 500, 6):
        total = weights[edges[i] : edges[i + 1]] @ cells[asked[i]]
        want = sorted(range(500), key=lambda d: (-round(total[d], 9), d))[:6]
        assert [docs[j] for j in np.lexsort((docs, -scores))[:6]] == want and np.allclose(scores, total[docs], rtol=1e-12)


def test_shard_prunes_exactly():
    rnd = np.random.default_rng(0)
    words, docs = rnd.integers(0, 12, 6000), rnd.integers(0, 2000, 6000)
    words, docs = np.unique(np.stack([words, docs]), axis=1)
    parts = np.round(rnd.random(len(words)) ** 4, 2)  # with ties
    shard = bm25_search.Shard(words, docs, parts)
    assert shard.find(np.array([3, 99])).tolist() == [3, -1]
    for asked in ([1], [0, 3, 5], list(range(12))):
        total = defaultdict(float)
        for w in asked:
            for d, p in zip(docs[words == w], parts[words == w], strict=True):
                total[int(d)] += p
        assert [d for _, d in shard.top(np.array(asked), np.ones(len(asked)), 7)] == [d for d, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:7]]


def labelled_rows(good, bad, n=400):
    rnd = random.Random(6)
    rows = [(i, (bad if i % 4 == 0 else good)(rnd)) for i in range(n)]
    return rows, [(i, int(i % 4 != 0)) for i in range(n)]


def prose(rnd):
    return " ".join("".join(rnd.choice("aeiounrst") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(20, 80))) + "."


def test_quality(spark, odd, none):
    rows, labels = labelled_rows(prose, lambda r: " ".join(w + r.choice(["###", "$$$", "|"]) for w in prose(r).split()))
    df, y = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id int, quality int")
    model = quality_rules.train(df, y)
    got = quality_rules.score(df, model).join(y, "doc_id").filter("held_out").collect()
    assert len(got) > 50 and all(r.predicted == r.quality and 0 <= r.score <= 1 for r in got)
    assert 0 < len(model.weights) < 60
    assert quality_rules.score(odd, model).count() == odd.count() and quality_rules.score(none, model).count() == 0
    assert set(quality_rules.keep(df, model).columns) == {"doc_id", "text"} and quality_rules.keep(odd, model).count() <= odd.count()
    flipped = y.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_rules.train(df, flipped) == model  # held-out labels aren't learned
    untaught = quality_rules.score(df, quality_rules.train(df, y.limit(0))).select("score").distinct().collect()
    assert [r.score for r in untaught] == [0.5]


def test_toxicity(spark, odd, none):
    def bad(r):
        w = prose(r).split()
        for _ in range(4):
            w[r.randrange(len(w))] = "zarg" + r.choice(["a", "el", "ons", "ut"])
        return " ".join(w)

    rows, labels = labelled_rows(prose, bad, 800)
    df, y = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(i, 1 - q) for i, q in labels], "doc_id int, toxic int")
    got = toxicity.score(df, y).join(y, "doc_id").filter("held_out").collect()
    assert len(got) > 150 and sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)
    assert toxicity.score(odd, y).count() == odd.count() and toxicity.score(none, y).count() == 0
    flipped = y.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert [r.score for r in toxicity.score(df, flipped).orderBy("doc_id").collect()] == pytest.approx([r.score for r in toxicity.score(df, y).orderBy("doc_id").collect()])
    untaught = toxicity.score(spark.createDataFrame([(1, "you are an idiot and a moron"), (2, "a fine day")], "doc_id int, text string"), y.limit(0)).collect()
    assert len(untaught) == 2


def test_quality_scores_by_hand(spark, odd):
    """Statistics, rules and the logistic sum recomputed in plain Python."""
    import math
    import re

    rows, labels = labelled_rows(prose, lambda r: " ".join(w + r.choice(["###", "| ", "!"]) for w in prose(r).split()))
    df, y = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id int, quality int")
    model = quality_rules.train(df, y)

    def by_hand(text):
        t = text or ""
        words, chars = max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t))), max(1, len(t))
        x = {"size": math.log1p(len(re.findall(r"[^\x20\x09-\x0D]+", t))), "word_length": len(t) / words}
        for name, (pattern, per) in quality_rules.COUNTS.items():
            x[name] = len(re.findall(pattern, t, re.ASCII)) / (words if per == "words" else chars)
        total = model.intercept + sum(w for rule, w in model.weights if all((x[n] > b) if above else (x[n] <= b) for n, above, b in rule.conditions))
        return 1 / (1 + math.exp(-total))

    for table in (df, odd.select("doc_id", "text")):
        for r in quality_rules.score(table, model).join(table, ["doc_id"], "inner").collect():
            same_id = [by_hand(t.text) for t in table.filter(F.col("doc_id").eqNullSafe(F.lit(r.doc_id))).collect()] if table is not df else [by_hand(r.text)]
            assert min(abs(r.score - s) for s in same_id) < 1e-9
    assert model.weights and all(len(rule.conditions) <= quality_rules.DEPTH for rule, _ in model.weights)


def test_label_model_is_plain_em():
    """Posteriors against expectation and maximisation written out loop by loop, with blocks of one voter."""
    rnd = np.random.default_rng(3)
    toxic = rnd.random(4000) < 0.2
    rates = np.array([[0.02, 0.7], [0.05, 0.5], [0.1, 0.6], [0.01, 0.3]])
    votes_of = np.stack([rnd.random(4000) < np.where(toxic, a, c) for c, a in rates], 1).astype(np.int8)
    votes, which = np.unique(votes_of, axis=0, return_inverse=True)
    counts = np.bincount(which).astype(float)
    known = np.stack([np.bincount(which[:400][~toxic[:400]], minlength=len(votes)), np.bincount(which[:400][toxic[:400]], minlength=len(votes))]).astype(float)
    model = toxicity.LabelModel(4)
    start = np.full((len(votes), len(model.SIDES)), 1.0 / len(model.SIDES)) + rnd.random((len(votes), len(model.SIDES))) * 0.1
    start /= start.sum(1, keepdims=True)
    got = model._em(votes, counts, known, start.copy(), 5)
    shares = start.copy()
    for _ in range(5):
        w = [[counts[p] * shares[p][k] for k in range(6)] for p in range(len(votes))]
        for y in (0, 1):
            for p in range(len(votes)):
                within = [shares[p][k] + 1e-12 if model.SIDES[k] == y else 0.0 for k in range(6)]
                for k in range(6):
                    w[p][k] += known[y][p] * within[k] / sum(within)
        total = sum(map(sum, w))
        prior = [(sum(row[k] for row in w) + 1e-3) / (total + 6e-3) for k in range(6)]
        new = []
        for p in range(len(votes)):
            joint = []
            for k in range(6):
                mass = prior[k]
                for v in range(4):
                    same = [q for q in range(len(votes)) if votes[q][v] == votes[p][v]]
                    fires, every = sum(w[q][k] for q in same) + 0.25, sum(w[q][k] for q in range(len(votes))) + 0.5
                    if k < 2:  # clean kinds lean on both together
                        pooled = (sum(w[q][j] for q in same for j in (0, 1)) + 0.5) / (sum(w[q][j] for q in range(len(votes)) for j in (0, 1)) + 1.0)
                        fires, every = fires + 0.02 * total * pooled, every + 0.02 * total
                    mass *= fires / every
                joint.append(mass)
            new.append([j / sum(joint) for j in joint])
        shares = np.array(new)
    assert np.allclose(got, shares, atol=1e-9)
    fitted = toxicity.LabelModel(4).fit(votes, counts, known).posterior(votes)[which]
    assert (fitted >= 0).all() and (fitted <= 1).all()
    assert ((fitted > 0.5) == toxic).mean() > 0.9 and fitted[toxic].mean() > 3 * fitted[~toxic].mean()


def test_sample_bounds_are_parameters(spark):
    rows, labels = labelled_rows(prose, lambda r: prose(r) + " zarga zargut zargel", 800)
    df, y = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(i, 1 - q) for i, q in labels], "doc_id int, toxic int")
    got = toxicity.score(df, y, most=60, taught=100).join(y, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)

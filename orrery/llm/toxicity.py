"""Toxicity by weak supervision.

Voters: a general lexicon, phrases, and lexicons of words and stems that a bounded sample of labelled texts shows to
be typical. Each says for a document whether it fires. A generative model of the votes over all documents, a mixture
of toxic and clean, is fitted by EM to the counts of the vote patterns: it estimates each voter's rates of firing
(its accuracy) and, from what the first fit leaves unexplained, which voters are correlated; those are joined in
blocks whose joint votes get rates of their own. Its posteriors over a bounded sample are the labels of a linear
classifier, which is compiled into a column.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import n_words, stored
from orrery.llm.learning import fold, labelled, logistic, logistic_columns

MAX_LABELLED = 2_500  # labelled texts to mine, of each class, at most
MAX_TAUGHT = 30_000  # documents whose posteriors teach the classifier, at most
MAX_TERMS = 96  # mined words and stems
MINED, STEMS = 5, 1  # lexicons that they are dealt to by precision, of terms and of repeated stems
EVIDENCE, REPEATED = 22.0, 14.0  # least G statistic of a mined term, and of a stem that texts have in several words
BLOCK, DEPENDENT = 3, 0.2  # voters in a block, and correlation that joins them, given the class

#: A small general lexicon, and phrases that address someone with contempt.
PERSONS = ["idiot", "idiots", "moron", "morons", "loser", "losers", "clown", "scum", "imbecile", "dumbass", "bastard", "vermin"]
SLURS = ["worthless", "pathetic", "disgusting", "stupid", "trash", "garbage", "filthy", "braindead", "retarded", "crap"]
PHRASES = r"\b(?:shut up|go die|kill yourself|(?:you|they) (?:are|re) (?:all )?(?:an? )?(?:idiot|moron|loser|clown|scum|trash|stupid|worthless|pathetic|disgusting))"
LETTERS = r"\p{L}"


def terms(text: Column) -> Column:
    """Distinct words of letters, whole (`word`) and as stems of 4 to 7 letters (`stem-`), a stem for each of its words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"{LETTERS}+"), F.lit(0)))
    stems = []
    for k in (4, 5, 6, 7):
        stems.append(F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("-"))))  # noqa: B023  called at once
    return F.concat(words, *stems)


def mine(rows: DataFrame) -> tuple[list[str], list[str]]:
    """Typical terms of the toxic ones of rows (text, y), and stems that are typical if repeated, best first.

    Evidence is the G statistic of the texts that have a term, or that have several words of one stem: where a stem
    alone is common or labels are few, its repetition still tells.
    """
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return [], []
    each = rows.select(F.monotonically_increasing_id().alias("row"), "y", F.explode(terms(F.col("text"))).alias("t")).groupBy("row", "y", "t").agg(F.count("*").alias("k"))
    toxic, again = F.col("y") == 1, F.col("k") > 1
    found = each.groupBy("t").agg(F.count_if(toxic).alias("a"), F.count_if(~toxic).alias("b"), F.count_if(toxic & again).alias("aa"), F.count_if(~toxic & again).alias("bb"))
    found = stored(found.filter("a + b > 1"), "terms")  # evidence asks for several texts
    na, nb = float(n[1]), float(n[0])

    def g(a: Column, b: Column) -> Column:
        part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
        return 2 * (part(a, (a + b) * na / (na + nb)) + part(b, (a + b) * nb / (na + nb)) + part(na - a, (na + nb - a - b) * na / (na + nb)) + part(nb - b, (na + nb - a - b) * nb / (na + nb)))

    a, b, aa, bb = (F.col(c).cast("double") for c in ("a", "b", "aa", "bb"))
    typical = lambda x, y: x / na > 10 * (y + 0.5) / (nb + 1)
    once = found.withColumn("g", g(a, b)).filter((F.col("g") >= EVIDENCE) & typical(a, b))
    repeated = found.withColumn("g", g(aa, bb)).filter((F.col("g") >= REPEATED) & typical(aa, bb) & ~typical(a, b)).withColumns({"a": F.col("aa"), "b": F.col("bb")})
    return _best(once), _best(repeated)


def _best(found: DataFrame) -> list[str]:
    """At most MAX_TERMS terms, without those that a better stem covers and without wider stems of no more texts; the most precise first."""
    kept: list[tuple[str, float, float]] = []
    for r in found.orderBy(F.col("g").desc(), F.length("t").desc(), "t").limit(20 * MAX_TERMS).collect():
        t, root = r["t"], r["t"].rstrip("-")
        covered = any(k.endswith("-") and root.startswith(k[:-1]) for k, *_ in kept)
        wider = t.endswith("-") and any(k.rstrip("-").startswith(root) and r["a"] <= 1.2 * n_k for k, n_k, _ in kept)
        if not covered and not wider:
            kept.append((t, r["a"], (r["b"] + 0.5) / (r["a"] + 1)))
    return [t for t, _, noise in sorted(kept[:MAX_TERMS], key=lambda x: (x[2], x[0]))]


def term_pattern(some: list[str]) -> str:
    """A pattern for any of the terms in a lower-cased text."""
    each = [re.escape(t[:-1]) if t.endswith("-") else re.escape(t) + f"(?!{LETTERS})" for t in sorted(some)]
    return rf"(?<!{LETTERS})(?:{'|'.join(each)})" if each else r"(?!)"


def voters(mined: list[str], repeated: list[str]) -> list[tuple[str, int]]:
    """The voters: a pattern over lower-cased texts, and how many matches make it fire."""
    deal = lambda x, n: [x[len(x) * i // n : len(x) * (i + 1) // n] for i in range(n)]
    lexicons = [term_pattern(x) for x in deal(mined, MINED)]
    return [(PHRASES, 1), (term_pattern(PERSONS), 1), (term_pattern(SLURS), 1), *[(x, k) for x in lexicons for k in (1, 2)], *[(term_pattern(x), 2) for x in deal(repeated, STEMS)]]


class LabelModel:
    """A mixture of kinds of clean and of toxic documents; in each kind, the joint votes of each block have rates.

    Kinds within a side take up that, say, texts of one language share their lexicons. A clean kind's rates lean on
    those of all clean documents as if POOLED of all documents stood behind them, so that a handful of documents on
    which many voters fire isn't taken for a clean kind of its own.
    """

    POOLED = 0.02

    SIDES = np.array([0, 0, 1, 1, 1, 1])

    def __init__(self, voters: int):
        self.voters, self.blocks = voters, [(i,) for i in range(voters)]

    def _codes(self, votes: np.ndarray) -> list[np.ndarray]:
        return [sum(votes[:, v].astype(int) << k for k, v in enumerate(b)) for b in self.blocks]

    def _expect(self, codes: list[np.ndarray]) -> np.ndarray:
        """Log of the joint density of each pattern and kind."""
        return np.log(self.priors) + sum(np.log(t[:, c]).T for t, c in zip(self.tables, codes, strict=True))

    @staticmethod
    def _shares(logs: np.ndarray) -> np.ndarray:
        e = np.exp(logs - logs.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _em(self, votes: np.ndarray, counts: np.ndarray, known: np.ndarray, shares: np.ndarray, rounds: int) -> np.ndarray:
        codes, side = self._codes(votes), [self.SIDES == y for y in (0, 1)]
        for _ in range(rounds):
            w = counts[:, None] * shares
            for y in (0, 1):
                within = shares * side[y] + 1e-12 * side[y]
                w += known[y][:, None] * within / within.sum(1, keepdims=True)
            self.priors = (w.sum(0) + 1e-3) / (w.sum() + 1e-3 * len(self.SIDES))
            self.tables = []
            for b, c in zip(self.blocks, codes, strict=True):
                t = np.stack([np.bincount(c, x, 1 << len(b)) for x in w.T]) + 0.5 / (1 << len(b))
                clean = t[side[0]].sum(0)
                t[side[0]] += self.POOLED * w.sum() * clean / clean.sum()
                self.tables.append(t / t.sum(1, keepdims=True))
            new = self._shares(self._expect(codes))
            if np.abs(new - shares).max() < 1e-6:
                break
            shares = new
        return new

    def fit(self, votes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 200) -> LabelModel:
        """votes: distinct patterns of 0 and 1; counts: documents of each; known: clean and toxic ones of each, by label.

        Known documents weigh as much as all together, so that the mixture's toxic kinds are the labels'.
        """
        rate = min(0.5, max(0.01, known[1].sum() / max(known.sum(), 1.0)))
        known = known * (counts.sum() / max(known.sum(), 1.0))
        first = np.where(votes.any(1), votes.argmax(1), -1)
        shares = np.full((len(votes), len(self.SIDES)), 1e-3)
        for y in (0, 1):
            kinds = np.flatnonzero(self.SIDES == y)
            shares[np.arange(len(votes)), kinds[np.maximum(first, 0) * len(kinds) // self.voters]] = np.where(first < 0, 0.01 * rate, 0.7)[:] if y else np.where(first < 0, 1.0, 0.3)
        shares /= shares.sum(1, keepdims=True)
        shares = self._em(votes, counts, known, shares, rounds)
        joined: dict[int, list[int]] = {i: [i] for i in range(self.voters)}
        residual = []
        for x in (counts[:, None] * shares).T:
            total = max(x.sum(), 1e-9)
            mean = (x @ votes) / total
            cov = ((votes - mean) * x[:, None]).T @ (votes - mean) / total
            sd = np.sqrt(np.clip(np.diag(cov), 1e-6, None))
            residual.append(np.abs(cov / sd / sd[:, None]) * (total > 20))
        self.correlations = np.max(residual, 0)
        pairs = sorted((-self.correlations[i, j], i, j) for i in range(self.voters) for j in range(i))
        for c, i, j in pairs:
            if -c >= DEPENDENT and joined[i] is not joined[j] and len(joined[i]) + len(joined[j]) <= BLOCK:
                joined[i] += joined[j]
                for k in joined[j]:
                    joined[k] = joined[i]
        self.blocks = sorted({tuple(sorted(b)) for b in joined.values()})
        self._em(votes, counts, known, shares, rounds)
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(self._shares(self._expect(self._codes(votes)))[:, self.SIDES == 1].sum(1), 0, 1)  # sums may round above 1


def score(df: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", mod: int = 3, held_out: int = 1, threshold: float = 0.7, most: int = MAX_LABELLED, taught: int = MAX_TAUGHT) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) for each row of df.

    Labels outside the held-out fold choose terms, in at most `most` texts of each class, and anchor the mixture; the
    classifier learns the posteriors of at most about `taught` documents, drawn by a hash of the id.
    Without labelled rows of both classes the general lexicon and phrases vote alone. If no voter fires anywhere,
    every score is the share of toxic labels, 0.01 without any. A null text is empty; no voter fires on an empty
    one. Null ids are outside the held-out fold. Repeated rows are scored alike. An empty table gives no rows.
    Other columns of df aren't read.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labelled(docs, labels, label, mod=mod, held_out=held_out, most=most, each_class=True)
    patterns = voters(*mine(known))
    n, ones = labels.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), mod) != held_out)).agg(F.count(label), F.coalesce(F.sum(label), F.lit(0))).first()
    prior = min(0.5, max(0.01, ones / n)) if n else 0.01
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    fired = [F.regexp_count(F.col("low"), F.lit(p)).alias(f"v{i}") for i, (p, _) in enumerate(patterns)]
    votes = df.select(F.col(doc_id).alias("doc_id"), low.alias("low")).select("doc_id", n_words(F.col("low")).alias("words"), *fired)
    votes = stored(votes, "votes")
    names = [f"v{i}" for i in range(len(patterns))]
    pattern = F.concat(*[F.when(F.col(v) >= least, "1").otherwise("0") for v, (_, least) in zip(names, patterns, strict=True)])
    seen = votes.groupBy(pattern.alias("p")).agg(F.count("*").alias("n")).collect()  # at most 2 ** len(patterns) rows
    told = labels.filter(F.col(label).isNotNull() & (fold(F.col("doc_id"), mod) != held_out)).select("doc_id", F.col(label).cast("int").alias("y"))
    told = votes.select("doc_id", pattern.alias("p")).join(told, "doc_id").groupBy("p").agg(F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") == 1).alias("toxic"))
    told = {r["p"]: (r["clean"], r["toxic"]) for r in told.collect()}
    table = np.array([[int(c) for c in r["p"]] for r in seen], np.int8).reshape(-1, len(patterns))
    out = votes.withColumn("held_out", fold(F.col("doc_id"), mod) == held_out)
    if table.any():
        counts = np.array([r["n"] for r in seen], float)
        known_votes = np.array([told.get(r["p"], (0, 0)) for r in seen], float).T
        model = LabelModel(len(patterns)).fit(table, counts, known_votes)
        teach = dict(zip((r["p"] for r in seen), model.posterior(table).tolist(), strict=True))
        spark = df.sparkSession
        posteriors = spark.createDataFrame(list(teach.items()), "p string, post double")
        total = float(counts.sum())
        u = F.pmod(F.xxhash64("doc_id", "words"), F.lit(1 << 30)) / float(1 << 30)
        sample = votes.filter(u < min(1.0, taught / total)).withColumn("p", pattern).join(F.broadcast(posteriors), "p")
        made = _features(names, [least for _, least in patterns])
        features = [f"f{i}" for i in range(len(made))]
        sides = sample.withColumn("y", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("w", F.when(F.col("y") == 1, F.col("post")).otherwise(1 - F.col("post")))
        sides = stored(sides.select("y", "w", *[c.alias(f) for f, c in zip(features, made, strict=True)]), "taught")
        if not sides.isEmpty():
            intercept, weights = logistic_columns(sides, features, label="y", weight="w", l1=0.0, l2=1e-4)
            score_ = logistic(intercept, list(zip(weights, made, strict=True)))
        else:
            score_ = F.lit(prior)
    else:
        score_ = F.lit(prior)
    out = out.select("doc_id", "held_out", score_.alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def _features(names: list[str], least: list[int]) -> list[Column]:
    """Of the classifier: each voter's vote and hits, damped, and all hits, damped and per word."""
    hits = sum((F.col(v) for v in names[1:]), F.col(names[0])).cast("double")
    votes = [(F.col(v) >= k).cast("double") for v, k in zip(names, least, strict=True)]
    return votes + [F.log1p(F.col(v).cast("double")) for v in names] + [F.log1p(hits), hits / F.greatest(F.col("words"), F.lit(1))]

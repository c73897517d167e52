"""Quality classifier: a sparse ensemble of rules.

Shallow trees are grown over statistics of a bounded sample of labelled texts. Each path from a root to a node is a
rule, the conjunction of its conditions; a lasso logistic regression over the rules leaves few with a weight. Those
rules are compiled into one Spark column expression, so scoring a corpus is a narrow projection of its texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import n_words, stored
from orrery.llm.learning import fold, labelled, logistic, logistic_columns

MAX_LABELLED = 12_000  # labelled rows to learn from, at most
TREES, DEPTH, L1 = 16, 3, 0.002

#: Statistics of a text: what is counted, and per what.
COUNTS = {
    "symbols": ("[#$%&*]", "words"), "pipes": (r"\|", "words"), "bangs": ("[!?]", "words"), "upper": ("[A-Z]", "chars"),
    "digits": ("[0-9]", "chars"), "stops": (r"\.", "words"), "lines": (r"\n", "words"),
    "repeats": (r"(?<!\S)(\S+)\s(?=\1(?!\S))", "words"),
}
STATISTICS = ["size", "word_length", *COUNTS]


def statistics(text: Column) -> dict[str, Column]:
    """The statistics as columns; all 0 for an empty or null text."""
    text = F.coalesce(text, F.lit(""))
    words = F.greatest(n_words(text), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    out = {"size": F.log1p(n_words(text).cast("double")), "word_length": F.length(text) / words}
    for name, (pattern, per) in COUNTS.items():
        out[name] = F.regexp_count(text, F.lit(pattern)) / (words if per == "words" else chars)
    return out


@dataclass(frozen=True)
class Rule:
    """A conjunction: of each condition, a statistic, whether it is above, and the bound."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self, within: str = "") -> Column:
        out = F.lit(True)
        for name, above, bound in self.conditions:
            c = F.col(within + name)
            out = out & (c > bound if above else c <= bound)
        return out.cast("double")


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, within: str = "") -> Column:
        """Over columns named as the statistics, after a prefix."""
        return logistic(self.intercept, [(w, rule.column(within)) for rule, w in self.weights])


def tree_rules(described: str, nodes: int) -> set[Rule]:
    """The paths of a forest, from its description; of conditions on one statistic the tightest stay.

    Each node but a root is one condition of the description; any other number of them is an error.
    """
    rules, path, seen = set(), [], 0
    for line in described.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (-?[0-9.Ee+-]+)\)", line)
        if not m:
            continue
        depth, seen = len(m[1]), seen + 1
        path = [p for p in path if p[0] < depth] + [(depth, STATISTICS[int(m[2])], m[3] == ">", float(m[4]))]
        tight: dict[tuple[str, bool], float] = {}
        for _, name, above, bound in path:
            tight[name, above] = (max if above else min)(bound, tight.get((name, above), bound))
        rules.add(Rule(tuple((name, above, bound) for (name, above), bound in sorted(tight.items()))))
    if seen != nodes:
        raise ValueError(f"{seen} conditions in the description of a forest of {nodes} nodes below its roots")
    return rules


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", mod: int = 4, held_out: int = 2, most: int = MAX_LABELLED, seed: int = 7) -> Model:
    """The rules and weights learned from labelled rows outside the held-out fold.

    Without labelled rows every score is 0.5; if all have one label, it is their smoothed share.
    """
    rows = labelled(docs, labels, label, mod=mod, held_out=held_out, most=most)
    rows = stored(rows.select("y", *[c.alias(k) for k, c in statistics(F.col("text")).items()]), "statistics")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n or ones in (0, n):
        from math import log

        return Model(log((ones + 1) / (n - ones + 1)), ())
    grow = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="onethird", seed=seed)
    forest = grow.fit(VectorAssembler(inputCols=STATISTICS, outputCol="x").transform(rows))
    rules = sorted(tree_rules(forest.toDebugString, forest.totalNumNodes - forest.getNumTrees), key=lambda r: r.conditions)
    marked = stored(rows.select("y", *[r.column().alias(f"r{i}") for i, r in enumerate(rules)]), "rules")
    intercept, weights = logistic_columns(marked, [f"r{i}" for i in range(len(rules))], label="y", l1=L1)
    return Model(intercept, tuple((r, w) for r, w in zip(rules, weights, strict=True) if w))


def score(df: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", mod: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) for each row of df.

    A null text is empty; an empty text has all statistics 0 and is scored by them. Null ids are outside the
    held-out fold. Repeated rows are scored alike. An empty table gives no rows. Other columns of df aren't read.
    """
    d = df.select(F.col(doc_id).alias("doc_id"), *[c.alias(k) for k, c in statistics(F.col(text)).items()])
    d = d.select("doc_id", (fold(F.col("doc_id"), mod) == held_out).alias("held_out"), model.score().alias("score"))
    return d.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep(df: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of df, unchanged, whose score is at least the threshold; nulls and repeated rows as in score()."""
    made = F.struct(*[c.alias(k) for k, c in statistics(F.col(text)).items()])
    # exploded, as a filter over a plain column would be pushed below it, and each rule would count anew
    counted = df.withColumn("__made", made).withColumn("__statistics", F.explode(F.array("__made")))
    return counted.filter(model.score("__statistics.") >= threshold).drop("__made", "__statistics")

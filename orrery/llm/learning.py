"""What the two trained scorers share: folds, bounded samples of labelled rows, and logistic models as columns."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import stored


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def labelled(docs: DataFrame, labels: DataFrame, label: str, *, mod: int, held_out: int, most: int, each_class: bool = False) -> DataFrame:
    """doc_id, text, y of labelled documents outside the held-out fold: at most about `most` (of each class, if so said).

    The sample is drawn by a hash of the id, so reruns agree. An id with several labels gets the label that most
    of them say, 1 on a tie. Null ids and null labels aren't used. As the sample is bounded, it may be broadcast.
    """
    y = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    y = y.filter(fold(F.col("doc_id"), mod) != held_out)
    key = F.when(F.lit(each_class), F.col("y")).otherwise(0)
    counts = {r["k"]: r["n"] for r in y.groupBy(key.alias("k")).agg(F.count("*").alias("n")).collect()}
    u = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(1.0)
    for k, n in counts.items():
        share = F.when(key == k, min(1.0, most / n)).otherwise(share)
    y = y.filter(u < share)
    return stored(docs.join(F.broadcast(y), "doc_id").select("doc_id", "text", "y"), "labelled")


def logistic_columns(rows: DataFrame, features: list[str], *, label: str, weight: str | None = None, l1: float, l2: float = 0.0, rounds: int = 100) -> tuple[float, list[float]]:
    """Intercept and weights of a logistic regression over plain columns."""
    reg, net = (l1 + l2, l1 / (l1 + l2)) if l1 + l2 else (0.0, 0.0)
    rows = VectorAssembler(inputCols=features, outputCol="x").transform(rows)
    fit = LogisticRegression(featuresCol="x", labelCol=label, regParam=reg, elasticNetParam=net, maxIter=rounds, standardization=True, family="binomial")
    if weight:
        fit = fit.setWeightCol(weight)
    model = fit.fit(rows)
    return float(model.intercept), [float(w) for w in model.coefficients.toArray()]


def logistic(intercept: float, terms: list[tuple[float, Column]]) -> Column:
    total = F.lit(intercept)
    for w, c in terms:
        total = total + F.lit(w) * c
    return 1 / (1 + F.exp(-total))

"""Feedback as an event log: mined rules, rules applied, and the state that the log folds to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.urls import host_suffixes, path_tokens
from orrery.operators.dedup import top


def mine(feedback: DataFrame, key: str, *, support: int, orgs: int) -> DataFrame:
    """Keys disputed at least `support` times by `orgs` organisations and never confirmed.

    One aggregation over the log: the two sides are conditional counts, not two scans.
    """
    wrong, right = F.col("verdict") == "wrong", F.col("verdict") == "confirmed"
    found = feedback.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(
        F.count_if(wrong).alias("support"), F.countDistinct(F.when(wrong, F.col("orgid"))).alias("orgs"), F.count_if(right).alias("confirms")
    )
    return found.filter((F.col("support") >= support) & (F.col("orgs") >= orgs) & (F.col("confirms") == 0))


def mine_tokens(feedback: DataFrame, url: str = "url", *, support: int = 4, orgs: int = 3) -> DataFrame:
    return mine(feedback.withColumn("token", F.explode(path_tokens(F.col(url)))), "token", support=support, orgs=orgs)


def rule_counts(feedback: DataFrame, rule: Column, examples: int = 5) -> DataFrame:
    """Support, organisations and confirmations of one rule, and its first disputed urls by id."""
    wrong = (F.col("verdict") == "wrong") & rule
    counts = feedback.agg(F.count_if(wrong).alias("support"), F.countDistinct(F.when(wrong, F.col("orgid"))).alias("orgs"), F.count_if((F.col("verdict") == "confirmed") & rule).alias("confirms"))
    firsts = feedback.filter(wrong).orderBy("id").limit(examples).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "url"))), lambda x: x["url"]), " ").alias("examples"))
    return counts.crossJoin(firsts)  # one row each


def apply_rules(df: DataFrame, rules: DataFrame, *, host: str, url: str, keys: list[str]) -> DataFrame:
    """df with action and pattern of the rule that fits its host or a token of its path.

    A deny wins over a flag, then the least rule id; a rule that fits without denying flags, whatever it says.
    Hosts and tokens meet the rules by equi joins, whatever the number of rules.
    """
    terms = F.concat(F.transform(host_suffixes(F.col(host)), lambda h: F.struct(F.lit("host").alias("t"), h.alias("p"))), F.transform(path_tokens(F.col(url)), lambda t: F.struct(F.lit("pattern").alias("t"), t.alias("p"))))
    hits = df.select(*keys, F.explode(terms).alias("x")).select(*keys, F.col("x.t").alias("rule_type"), F.col("x.p").alias("pattern")).join(rules, ["rule_type", "pattern"])
    hits = top(hits, keys, [(F.col("action") == "deny").desc(), F.col("rule_id")])
    hits = hits.select(*keys, F.when(F.col("action") == "deny", "deny").otherwise("flag").alias("action"), "pattern")
    return df.join(hits, keys, "left").withColumns({"action": F.coalesce("action", F.lit("")), "pattern": F.coalesce("pattern", F.lit(""))})


def last_write_wins(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """An upsert that overwrites: the last row of each key."""
    return top(log, keys, order)


def counted(log: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """An upsert that counts: hits, the last value that isn't empty, the last sequence number."""
    filled = F.when(F.col(value) != "", F.col(seq))
    return log.groupBy(*keys).agg(F.count("*").alias("hits"), F.coalesce(F.max_by(value, filled), F.lit("")).alias(value), F.max(seq).alias("last_seq"))


def refreshed(old: DataFrame, new: DataFrame, keys: list[str], *, kept: dict[str, str], counts: list[str]) -> DataFrame:
    """Mined rules merged into known ones: counts are refreshed, what people decided stays, new ones are proposed."""
    o, n = old.alias("o"), new.alias("n")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"o.{k}") == F.col(f"n.{k}"))
    cols = [F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys]
    cols += [F.coalesce(F.col(f"o.{c}"), F.lit(v)).alias(c) for c, v in kept.items()]
    cols += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in counts]
    return o.join(n, on, "full").select(*cols)


def standing(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """What confirmations and disputes leave: keys whose last event confirms, with the numbers of both."""
    out = log.groupBy(*keys).agg(F.max_by("verdict", seq).alias("verdict"), F.count_if(F.col("verdict") == "confirmed").alias("confirms"), F.count_if(F.col("verdict") == "wrong").alias("disputes"))
    return out.filter(F.col("verdict") == "confirmed").drop("verdict")


def without(df: DataFrame, **equal: str) -> DataFrame:
    """A delete by value: nulls stay."""
    for name, value in equal.items():
        df = df.filter(~F.col(name).eqNullSafe(F.lit(value)))
    return df

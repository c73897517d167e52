"""Rounds over a frontier of stored pages: each organisation is expanded by one strategy after the other until it has what it needs.

A strategy is a table of edges (source, target, score, pos). A round follows the edges of the pages that the last
round brought, for organisations that have no accepted page yet, to targets that they haven't visited: the best
`budget` of them for each organisation. A strategy ends after its rounds, or as soon as a round brings nothing;
the next one starts from all that was visited. Settled organisations take no part any more, so what is joined
shrinks to those that are still empty.

A strategy's edges are written once, and not at all when every organisation is settled. Each round is written to the shared folder and counted while it is written. The seen set is dealt by organisation
and page with the targets it is held against; no round is collected, and no organisation's pages are in one task
but in Spark's sorted windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from orrery.operators.dedup import top
from orrery.sources.tables import scratch

VISITED = ["org", "key", "source", "strategy", "round", "accepted"]


@dataclass(frozen=True)
class Strategy:
    name: str
    edges: DataFrame  # source, target, score, pos
    rounds: int
    budget: int  # new pages of an organisation in a round


def explored(starts: DataFrame, strategies: list[Strategy], accepted: DataFrame) -> tuple[DataFrame, list[tuple[str, int, int, int]]]:
    """All visited pages (org, key, source, strategy, round, accepted), and for each round its strategy, number, new pages and those accepted.

    starts: org and key, round 0. accepted: key. Of two ways to a page in one round the better edge counts (score, then
    pos, then the lesser source); of targets, the better edge, then the lesser key. Nulls are no organisation and no page.
    Repeated starts count once. A round without new pages isn't listed.
    """
    spark, log = starts.sparkSession, []
    good = accepted.select("key").filter("key IS NOT NULL").distinct().withColumn("accepted", F.lit(True))

    def written(df: DataFrame, strategy: str, nth: int) -> tuple[DataFrame, int]:
        seen, at = Observation(), scratch(spark, f"round-{nth}")
        rows = df.withColumns({"strategy": F.lit(strategy), "round": F.lit(nth)}).join(good, "key", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))).select(*VISITED)
        rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("accepted")).write.parquet(at)
        n = seen.get["n"]
        if n:
            log.append((strategy, nth, n, seen.get["accepted"]))
        return spark.read.schema(rows.schema).parquet(at), n

    first = starts.select("org", "key", F.lit(None).cast(starts.schema["key"].dataType).alias("source")).filter("org IS NOT NULL AND key IS NOT NULL").dropDuplicates(["org", "key"])
    visited, _ = written(first, "start", 0)
    nth = 0
    for s in strategies:
        if visited.select("org").join(visited.filter("accepted").select("org"), "org", "left_anti").isEmpty():
            break
        at = scratch(spark, f"edges-{s.name}")  # once for all rounds of the strategy
        s.edges.select("source", F.col("target").alias("key"), "score", "pos").filter("source IS NOT NULL AND key IS NOT NULL").write.parquet(at)
        edges, frontier = spark.read.parquet(at), visited
        for _ in range(s.rounds):
            settled = visited.filter("accepted").select("org").distinct()
            still = visited.select("org", "key").join(settled, "org", "left_anti")  # what organisations without an accepted page have seen
            sources = frontier.select("org", F.col("key").alias("source")).join(settled, "org", "left_anti")
            steps = sources.join(edges, "source").join(still, ["org", "key"], "left_anti")
            best = top(steps, ["org", "key"], [F.col("score").desc(), F.col("pos"), F.col("source")])
            fresh = top(best, ["org"], [F.col("score").desc(), F.col("pos"), F.col("key")], s.budget).select("org", "key", "source")
            nth += 1
            frontier, n = written(fresh, s.name, nth)
            if not n:
                break
            visited = visited.unionByName(frontier)
    return visited, log


def found(visited: DataFrame) -> DataFrame:
    """A row per organisation: its accepted page of the earliest round (the least of equals) with strategy and round, else nulls; and how many pages it took."""
    first = F.min(F.when(F.col("accepted"), F.struct("round", "key", "strategy")))
    return visited.groupBy("org").agg(first.alias("f"), F.count("*").alias("n_visited")).select("org", "f.key", "f.strategy", "f.round", "n_visited")

"""Queries over verdicts, ladders, evaluation and streams."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import blobs
from orrery.operators import dedup, evaluation, verdicts
from orrery.plans.roles import JUDGED, PAGE_PARTS, Registry, judged
from orrery.sources.tables import parquet, scratch, streamed
from orrery.streaming import discover, runs, signals

R = Registry()
SEVERE = "CASE verdict WHEN 'No' THEN 3 WHEN 'Maybe' THEN 2 ELSE 1 END"
TOP = f"SELECT org, arg_max(verdict, n * 10 + s) AS verdict FROM (SELECT org, verdict, count(*) AS n, {SEVERE} AS s FROM judged GROUP BY org, verdict) GROUP BY org"


@R.query(f"WITH {JUDGED} {TOP}")
def verdict_majority(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.majority(judged(spark, d), "org")


@R.query(
    f"""WITH {JUDGED}, m AS ({TOP}), t AS (SELECT org, max({SEVERE}) AS s FROM judged WHERE lang = 'es' GROUP BY org)
    SELECT m.org, CASE t.s WHEN 3 THEN 'No' WHEN 2 THEN 'Maybe' WHEN 1 THEN 'Yes' ELSE m.verdict END AS verdict FROM m LEFT JOIN t USING (org)"""
)
def verdict_terms_first(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.terms_first(judged(spark, d), "org", F.col("lang") == "es")


RUNGS = ["exact", "parent", "domain", "vendor"]
HITS_SQL = "hits AS (SELECT o_custkey AS org, ['domain', 'vendor', 'exact', 'parent', 'none'][o_orderkey % 5 + 1] AS level, 'u' || o_orderkey AS url FROM orders)"
NTH = "list_position(['exact', 'parent', 'domain', 'vendor'], level)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders")
    level = F.element_at(F.lit(["domain", "vendor", "exact", "parent", "none"]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(F.col("o_custkey").alias("org"), level.alias("level"), F.concat(F.lit("u"), F.col("o_orderkey")).alias("url"))


@R.query(f"WITH {HITS_SQL}, b AS (SELECT org, min({NTH}) AS n FROM hits WHERE {NTH} > 0 GROUP BY org) SELECT h.org, level, url FROM hits h JOIN b ON h.org = b.org AND {NTH} = n")
def ladder_first(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.first_rung(_hits(spark, d), ["org"], RUNGS)


@R.query(
    f"""WITH {HITS_SQL}, b AS (SELECT org, min({NTH}) AS n FROM hits WHERE {NTH} > 0 GROUP BY org),
    c AS (SELECT h.org, n, string_agg(DISTINCT url, chr(10) ORDER BY url) AS cell FROM hits h JOIN b ON h.org = b.org AND {NTH} = n GROUP BY ALL)
    SELECT org, {', '.join(f"CASE WHEN n > {i} THEN 'n/a' WHEN n = {i} THEN cell ELSE '' END AS {r}" for i, r in enumerate(RUNGS, 1))} FROM c"""
)
def waterfall_pivot(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.waterfall(verdicts.first_rung(_hits(spark, d), ["org"], RUNGS), ["org"], RUNGS)


@R.query(f"WITH {JUDGED} SELECT lang, count(*) AS n, count(*) FILTER (verdict = 'Yes') AS correct, round(100.0 * count(*) FILTER (verdict = 'Yes') / count(*), 1) AS accuracy_pct FROM judged GROUP BY lang")
def eval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.report(judged(spark, d), "lang", F.col("verdict") == "Yes")


@R.query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (b.k IS NULL) AS only_first, count(*) FILTER (a.k IS NULL) AS only_second FROM a FULL JOIN b ON a.k = b.k")
def shadow_compare(spark: SparkSession, d: str) -> DataFrame:
    o = parquet(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return evaluation.overlap(o.filter("o_orderstatus = 'F'"), o.filter("o_orderpriority = '1-URGENT'"), ["k"])


@R.query(
    """WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT user_id, run::BIGINT AS run, event_type, count(*) AS length FROM r GROUP BY ALL HAVING count(*) >= 3"""
)
def spa_runs(spark: SparkSession, d: str) -> DataFrame:
    found = runs.runs(parquet(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])
    return found.filter("length >= 3").drop("first")


@R.query(
    """WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c), l AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL)
    SELECT user_id AS key, count(*) FILTER (n >= 3) AS n_runs FROM l GROUP BY user_id"""
)
def stream_runs(spark: SparkSession, d: str) -> DataFrame:
    """The runs again, from a stream that keeps the state of each key."""
    return runs.tracked(streamed(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], table=scratch(spark, "runs"), checkpoint=scratch(spark, "runs-log")).select("key", "n_runs")


@R.query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = streamed(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return runs.drained(counts, table=scratch(spark, "counts"), checkpoint=scratch(spark, "counts-log"))


@R.query(
    f"""WITH {PAGE_PARTS}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY page_id) AS n FROM canon) WHERE n = 1 AND dedup_key NOT IN (SELECT dedup_key FROM canon WHERE contains(path, '/de/1')))
    SELECT page_id, dedup_key AS key, CASE WHEN root = 'example.net' THEN 'flag' ELSE '' END AS action FROM f WHERE NOT regexp_matches(host, '(^|\\.)example\\.org$')"""
)
def stream_discover(spark: SparkSession, d: str) -> DataFrame:
    """Pages as a stream of candidates: disputed keys and denied hosts go, flagged ones are marked."""
    active = spark.createDataFrame([(1, "host", "example.net", "flag"), (2, "host", "example.org", "deny")], "rule_id int, rule_type string, pattern string, action string")
    table = parquet(spark, d, "pages")
    disputed = table.filter(F.col("url").contains("/de/1")).select(discover.urls.dedup_key(F.col("url")).alias("key"))
    found = discover.discover(streamed(spark, d, "pages"), active, disputed, table=scratch(spark, "candidates"), checkpoint=scratch(spark, "candidates-log"))
    return found.select("page_id", "key", "action")


@R.query(
    """WITH s AS (SELECT o_custkey AS org, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey), w AS (SELECT c_custkey AS org FROM customer)
    SELECT CASE WHEN status IS NULL THEN 'new' WHEN status = 'F' THEN 'skipped' WHEN status = 'P' THEN 'failed' ELSE 'again' END AS work, count(*) AS n FROM w LEFT JOIN s USING (org) GROUP BY 1"""
)
def resumed_work(spark: SparkSession, d: str) -> DataFrame:
    """What a restarted run has to do: organisations by the last status that an earlier run left."""
    last = dedup.top(parquet(spark, d, "orders"), ["o_custkey"], [F.col("o_orderkey").desc()]).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"))
    work = F.when(F.col("status").isNull(), "new").when(F.col("status") == "F", "skipped").when(F.col("status") == "P", "failed").otherwise("again")
    return parquet(spark, d, "customer").join(last, "c_custkey", "left").groupBy(work.alias("work")).agg(F.count("*").alias("n"))


@R.query("SELECT s_suppkey, s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS miss, CASE WHEN s_suppkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN (SELECT c_acctbal FROM customer WHERE c_custkey = s_suppkey) ELSE -1 END AS value FROM supplier")
def cache_read_through(spark: SparkSession, d: str) -> DataFrame:
    """Cached values where there are, and which keys must be fetched; empty results were never cached."""
    cache = parquet(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_acctbal").alias("cached"))
    joined = parquet(spark, d, "supplier").select("s_suppkey").join(cache, "s_suppkey", "left")
    return joined.select("s_suppkey", F.col("cached").isNull().alias("miss"), F.coalesce("cached", F.lit(-1.0)).alias("value"))


@R.query(
    """SELECT o_custkey, '{"ids":[' || string_agg(o_orderkey, ',' ORDER BY o_orderkey) || '],"top":{"status":"' || arg_max(o_orderstatus, o_orderkey) || '"}}' AS results, count(*) AS n, max(o_orderkey) AS last_id, arg_max(o_orderstatus, o_orderkey) AS top_status FROM orders GROUP BY o_custkey"""
)
def search_log(spark: SparkSession, d: str) -> DataFrame:
    """Results as JSON, and what is read back from them."""
    log = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"), F.max_by("o_orderstatus", "o_orderkey").alias("status"), F.count("*").alias("n"))
    log = log.select("o_custkey", blobs.written(F.struct("ids", F.struct("status").alias("top"))).alias("results"), "n")
    v = blobs.read(F.col("results"))
    return log.select("o_custkey", "results", "n", F.try_element_at(blobs.value(v, "$.ids", "array<bigint>"), F.lit(-1)).alias("last_id"), blobs.value(v, "$.top.status", "string").alias("top_status"))


@R.query(
    """WITH b AS (SELECT event_id, user_id, CASE WHEN user_id % 5 = 0 THEN left(props, length(props) - 1) ELSE props END AS blob FROM events)
    SELECT user_id, count(*) AS n, count(*) FILTER (NOT json_valid(blob)) AS n_bad, sum(CASE WHEN json_valid(blob) THEN CAST(json_extract_string(blob, '$.k') AS BIGINT) END) AS sum_k FROM b GROUP BY user_id"""
)
def blob_values(spark: SparkSession, d: str) -> DataFrame:
    """Fields of events' JSON by user; the JSON of a fifth of the users is torn."""
    torn = F.when(F.col("user_id") % 5 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    v = blobs.read(torn)
    e = parquet(spark, d, "events").select("user_id", v.alias("v"), torn.alias("blob"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(blobs.bad(F.col("blob"))).alias("n_bad"), F.sum(blobs.value(F.col("v"), "$.k", "bigint")).alias("sum_k"))


@R.query(
    """WITH due AS (SELECT user_id::VARCHAR AS key, event_type AS value, ts FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR),
    o AS (SELECT *, row_number() OVER w AS i, CASE WHEN lag(value) OVER w = value AND ts - lag(ts) OVER w <= INTERVAL 40 DAY THEN 0 ELSE 1 END AS starts FROM due WINDOW w AS (PARTITION BY key ORDER BY ts, value)),
    r AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY i) AS nth, min(ts) OVER (PARTITION BY key, run) AS since FROM r)
    SELECT key, value, since, ts AS at FROM n WHERE nth = 3"""
)
def stream_signals(spark: SparkSession, d: str) -> DataFrame:
    """Users whose events were of one type three times in a row, as a stream with state, up to the watermark of six hours."""
    found = signals.signals(streamed(spark, d, "events"), key="user_id", value="event_type", at="ts", delay="6 hours", idle=timedelta(days=40))
    out = signals.landed(found, table=scratch(spark, "signals"), checkpoint=scratch(spark, "signals-log"))
    return out.select("key", "value", F.col("since").cast("timestamp_ntz").alias("since"), F.col("at").cast("timestamp_ntz").alias("at"))

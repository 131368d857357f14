"""Cache queries from recorded counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linklens.functions.codecs import shard_for
from linklens.operators import counters as C
from linklens.operators import metrics as M
from linklens.plans import q_seq
from linklens.plans import views as V
from linklens.plans.catalog import query
from linklens.plans.views import with_views

# --- fixed query parameters ---
SCRAPE_MS = 3_600_000
SHARDS = 4
TIERS = ("l1", "l2")
# ------------------------------


def counter_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly scrapes of each instance's counters: requests, cache events by tier and outcome, shard queries.

    Every resolved read counts at the tiers that it reached, by the attribution of
    :func:`q_seq.attributed_reads`; other requests count on their own routes and, where they write, at their shard.
    """
    def event(name: str, *labels) -> Column:
        return F.struct(F.lit(name).alias("name"), F.create_map(*labels).alias("labels"))

    def cache(tier: str, outcome: str):
        return event(C.CACHE_EVENTS, F.lit("tier"), F.lit(tier), F.lit("outcome"), F.lit(outcome))

    def shard(operation: str):
        return event(C.SHARD_QUERIES, F.lit("operation"), F.lit(operation),
                     F.lit("shard"), shard_for("code", SHARDS).cast("string"))

    none = F.array().cast("array<struct<name:string,labels:map<string,string>>>")
    reads = q_seq.attributed_reads(spark, sf).select(
        "instance", "ts_ms", "code", F.concat(F.lit("/"), F.col("code")).alias("path"), F.lit("GET").alias("method"),
        F.lit(302).alias("status"), F.lit("click").alias("event_type"), F.col("tier").alias("answered"))
    others = V.requests(spark, sf).where(~F.col("event_type").eqNullSafe("click")).select(
        "instance", "ts_ms", "code", "path", "method", "status", "event_type", F.lit(None).cast("string").alias("answered"))
    request = event(C.REQUESTS, F.lit("route"), M.route_template("path"), F.lit("method"), F.col("method"),
                    F.lit("status"), F.col("status").cast("string"))
    kind, answered = F.col("event_type"), F.col("answered")
    more = (F.when(answered == "l1", F.array(cache("l1", "hit")))
            .when(answered == "l2", F.array(cache("l1", "miss"), cache("l2", "hit")))
            .when(answered == "l3", F.array(cache("l1", "miss"), cache("l2", "miss"), shard(C.LOOKUP)))
            .when(kind == "signup", F.array(shard("insert"))).when(kind == "purchase", F.array(shard("delete"))).otherwise(none))
    steps = (reads.unionByName(others)
             .select("instance", F.call_function("div", F.col("ts_ms"), F.lit(SCRAPE_MS)).alias("hour"),
                     F.explode(F.concat(F.array(request), more)).alias("e"))
             .select("instance", "hour", "e.name", "e.labels").withColumn("key", M.canonical_labels("labels"))
             .groupBy("instance", "name", "key", "hour").agg(F.any_value("labels").alias("labels"), F.count(F.lit(1)).alias("n")))
    # one row for each series and hour: the running sum sorts scrapes, not requests
    series = Window.partitionBy("instance", "name", "key").orderBy("hour")
    return steps.select("instance", "name", "labels", ((F.col("hour") + 1) * SCRAPE_MS).alias("scrape_ms"),
                        F.sum("n").over(series).cast("double").alias("value"))


EFFECTIVENESS_SQL = f"""
    SELECT count(*) AS requests, count(*) FILTER (WHERE tier = 'l3') AS lookups,
           CASE WHEN count(*) = 0 THEN 0.0 ELSE
             floor(CAST(count(*) - count(*) FILTER (WHERE tier = 'l3') AS DOUBLE) / count(*) * 1000.0 + 0.5) / 10.0
           END AS effectiveness
    FROM ({q_seq._tier_sql()})"""


@query("cache_effectiveness", with_views(EFFECTIVENESS_SQL, "requests", "request_links"))
def q_cache_effectiveness(spark, sf):
    return C.cache_effectiveness(C.counter_growth(counter_samples(spark, sf)))


@query("tier_hit_ratio", with_views(f"""
    WITH t AS ({q_seq._tier_sql()}),
    c AS (SELECT 'l1' AS cache_tier, count(*) FILTER (WHERE tier = 'l1') AS hits,
                 count(*) FILTER (WHERE tier <> 'l1') AS misses FROM t
          UNION ALL
          SELECT 'l2', count(*) FILTER (WHERE tier = 'l2'), count(*) FILTER (WHERE tier = 'l3') FROM t)
    SELECT cache_tier, hits, misses,
           CASE WHEN hits + misses = 0 THEN 0.0
                ELSE floor(CAST(hits AS DOUBLE) / (hits + misses) * 1000.0 + 0.5) / 10.0 END AS hit_pct
    FROM c""", "requests", "request_links"))
def q_tier_hit_ratio(spark, sf):
    """One row for each tier, also for one that no read reached."""
    ratio = C.tier_hit_ratio(C.counter_growth(counter_samples(spark, sf)))
    tiers = spark.createDataFrame([(t,) for t in TIERS], "cache_tier string")
    return tiers.join(ratio, "cache_tier", "left").select(
        "cache_tier", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"),
        F.coalesce("misses", F.lit(0)).cast("long").alias("misses"), F.coalesce("hit_pct", F.lit(0.0)).alias("hit_pct"))

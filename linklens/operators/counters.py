"""Reports from recorded counters: growth between two scrapes, cache effectiveness, hit ratio by tier.

Samples are rows (instance, name, labels map, scrape_ms, value) of counters
that only grow while an instance lives. Growth is one partial and final
aggregate over them; series are few (bounded label sets), samples are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.functions.text import percent
from linklens.operators.metrics import canonical_labels

# --- fixed values ---
REQUESTS = "linklens_http_requests_total"
CACHE_EVENTS = "linklens_cache_events_total"
SHARD_QUERIES = "linklens_shard_queries_total"
LOOKUP = "findByCode"
# --------------------


def counter_growth(samples: DataFrame, before_ms: int | None = None, after_ms: int | None = None) -> DataFrame:
    """(name, labels, growth, instances): last value up to ``after_ms`` less the last up to ``before_ms``, over all instances.

    A series without a sample up to ``before_ms`` (or with no such time given)
    grows from 0; without ``after_ms`` the last sample counts.
    """
    def last(at_ms: int | None) -> Column:
        sample = F.struct("scrape_ms", "value")
        return F.max(sample if at_ms is None else F.when(F.col("scrape_ms") <= at_ms, sample))["value"]

    start = F.lit(0.0) if before_ms is None else F.coalesce(last(before_ms), F.lit(0.0))
    per = samples.groupBy("instance", "name", canonical_labels("labels").alias("_key")).agg(
        F.any_value("labels").alias("labels"), (F.coalesce(last(after_ms), F.lit(0.0)) - start).alias("growth"))
    return per.groupBy("name", "_key").agg(F.any_value("labels").alias("labels"), F.sum("growth").alias("growth"),
                                           F.count(F.lit(1)).alias("instances")).drop("_key")


def _of(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("growth"))), F.lit(0.0)).cast("long").alias(name)


def cache_effectiveness(growth: DataFrame, route: str = "/:code") -> DataFrame:
    """(requests, lookups, effectiveness): share of the route's requests answered without a lookup in a shard.

    Hits and misses of the tiers are not summed: a read that misses the first
    tier and hits the second counts in both. Writes to shards are no lookups.
    """
    name, labels = F.col("name"), F.col("labels")
    out = growth.agg(_of((name == REQUESTS) & (labels["route"] == route), "requests"),
                     _of((name == SHARD_QUERIES) & (labels["operation"] == LOOKUP), "lookups"))
    return out.withColumn("effectiveness", percent(F.col("requests") - F.col("lookups"), F.col("requests")))


def tier_hit_ratio(growth: DataFrame) -> DataFrame:
    """(cache_tier, hits, misses, hit_pct): share of the reads that reached each tier; tiers never consulted have no row."""
    labels = F.col("labels")
    per = growth.where(F.col("name") == CACHE_EVENTS).groupBy(labels["tier"].alias("cache_tier")).agg(
        _of(labels["outcome"] == "hit", "hits"), _of(labels["outcome"] == "miss", "misses"))
    return per.where(F.col("hits") + F.col("misses") > 0).withColumn(
        "hit_pct", percent("hits", F.col("hits") + F.col("misses")))

"""Joins between request logs and the link table.

Join strategy: link tables are joined without a hint, so Spark broadcasts it only when its estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` (the checked bound) and AQE can demote
or split the join at run time; otherwise it is a shuffle join on ``code`` and
skewed codes are split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.functions.codecs import fnv1a32_literal, shard_for
from linklens.functions.text import is_plausible_code

OUTCOME_STATUS = {"invalid": 404, "ok": 302, "not_found": 404, "expired": 410}


def screen_requests(requests: DataFrame, code_col: str = "code") -> DataFrame:
    """Keep only requests whose code could exist (placed before any join)."""
    return requests.where(is_plausible_code(code_col))


def resolve_requests(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Every request -> outcome invalid / ok / not_found / expired, status and target.

    Expiry is judged at request time: ``expires_at <= ts_ms`` is expired.
    One pass and one join: implausible codes have a null join key, which matches nothing.
    """
    keyed = requests.withColumn("_plausible", is_plausible_code("code")).withColumn(
        "_key", F.when(F.col("_plausible"), F.col("code")))
    lk = links.select(F.col("code").alias("_code"), F.col("url").alias("target"), F.col("expires_at").alias("_exp"))
    joined = keyed.join(lk, F.col("_key") == F.col("_code"), "left")
    outcome = (F.when(~F.coalesce(F.col("_plausible"), F.lit(False)), "invalid")
               .when(F.col("_code").isNull(), "not_found")
               .when(F.col("_exp").isNotNull() & (F.col("_exp") <= F.col("ts_ms")), "expired")
               .otherwise("ok"))
    out = joined.withColumn("outcome", outcome).drop("_plausible", "_key", "_code", "_exp")
    out = out.withColumn("target", F.when(F.col("outcome") == "ok", F.col("target")))
    status = F.create_map(*[x for kv in OUTCOME_STATUS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return out.withColumn("http_status", status[F.col("outcome")].cast("int"))


def redirect_outcomes(resolved: DataFrame) -> DataFrame:
    """Tally of outcomes per instance (the redirects counter)."""
    return resolved.groupBy("outcome", "instance").agg(F.count(F.lit(1)).alias("n"))


def missing_codes(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Probes for codes that do not exist (cache-penetration report): count per (code, client)."""
    probes = screen_requests(requests).join(links.select("code"), "code", "left_anti")
    return probes.groupBy("code", "client").agg(F.count(F.lit(1)).alias("probes"),
                                                F.min("ts_ms").alias("first_ms"),
                                                F.max("ts_ms").alias("last_ms"))


def lookup_codes(links_by_shard: DataFrame, codes: list[str], shards: int) -> DataFrame:
    """Point lookup of a literal code list touching only the shards involved.

    The shard of each literal is computed on the driver (the list is the
    caller's input, not table data) and added as ``shard IN (...)`` so a
    shard-partitioned table is pruned at planning time.
    """
    wanted = sorted({fnv1a32_literal(c) % shards if shards > 1 else 0 for c in codes})
    return links_by_shard.where(F.col("shard").isin(wanted) & F.col("code").isin(list(codes)))


def click_enrich(clicks: DataFrame, links: DataFrame, shards: int = 4) -> DataFrame:
    """Clicks joined to their link: target url and owner shard per click (left join)."""
    lk = links.select("code", F.col("url").alias("target"), F.col("id").alias("link_id"))
    return (clicks.join(lk, "code", "left")
            .withColumn("shard", shard_for("code", shards)))

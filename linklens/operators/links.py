"""Link-table changes and shard statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linklens.functions.codecs import fnv1a32, shard_for
from linklens.functions.text import percent


def live_links(links: DataFrame, now_ms: int) -> DataFrame:
    """Links valid at ``now``: no expiry, or expiry strictly after now (``<= now`` is expired)."""
    return links.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now_ms)))


def reap_expired(links: DataFrame, now_ms: int) -> DataFrame:
    """Flag rows a reaper would remove; kept = ``~reaped``."""
    return links.withColumn("reaped", F.coalesce(F.col("expires_at") <= F.lit(now_ms), F.lit(False)))


def coalesce_clicks(clicks: DataFrame) -> DataFrame:
    """One delta per code: number of clicks and latest access (partial + final aggregation)."""
    return clicks.groupBy("code").agg(F.count(F.lit(1)).alias("count"),
                                      F.max("ts_ms").alias("last_accessed_at"))


def apply_clicks(links: DataFrame, deltas: DataFrame) -> DataFrame:
    """``clicks += count``; ``last = greatest(coalesce(last, 0), delta ts)``; unknown codes ignored.

    A left join from the link table keeps every link and drops deltas for
    codes that are not stored (deleted links).
    """
    d = deltas.select("code", F.col("count").alias("_d_count"), F.col("last_accessed_at").alias("_d_last"))
    j = links.join(d, "code", "left")
    return j.select(
        *[c for c in links.columns if c not in ("clicks", "last_accessed_at")],
        (F.col("clicks") + F.coalesce(F.col("_d_count"), F.lit(0))).cast("long").alias("clicks"),
        F.when(F.col("_d_count").isNull(), F.col("last_accessed_at"))
         .otherwise(F.greatest(F.coalesce(F.col("last_accessed_at"), F.lit(0)), F.col("_d_last")))
         .cast("long").alias("last_accessed_at"),
    ).select(*links.columns)


def insert_unique(stored: DataFrame, batch: DataFrame, arrival_cols=("created_at", "id")) -> DataFrame:
    """Insert a batch; one winner per code. Returns the batch with ``status``.

    A code already stored, or taken earlier in the same batch (by arrival
    order, then id), is rejected as ``ALIAS_TAKEN``. The first arrival of a
    code is a partial and final aggregate joined back, so a hot code meets no
    window of all its rows and AQE may split its join partition. The window
    only numbers rows that agree in code, arrival and id. Null codes are one
    code; a stored null code takes none.
    """
    arrival = F.struct(*[F.col(c) for c in arrival_cols])
    first = batch.groupBy(F.col("code").alias("_code")).agg(F.min(arrival).alias("_first"))
    copies = Window.partitionBy("code", *arrival_cols).orderBy(F.lit(0))
    numbered = batch.withColumn("_copy", F.row_number().over(copies))
    taken = stored.select("code").distinct().withColumn("_stored", F.lit(True))
    j = numbered.join(first, F.col("code").eqNullSafe(F.col("_code")), "left").join(taken, "code", "left")
    wins = arrival.eqNullSafe(F.col("_first")) & (F.col("_copy") == 1) & F.col("_stored").isNull()
    status = F.when(wins, "inserted").otherwise("ALIAS_TAKEN")
    return j.withColumn("status", status).drop("_code", "_first", "_copy", "_stored")


def inserted_links(stored: DataFrame, decided: DataFrame) -> DataFrame:
    """The new table: stored rows plus winners, clicks 0 and no last access."""
    new = (decided.where(F.col("status") == "inserted")
           .select("id", "code", "url", "created_at", "expires_at",
                   F.lit(0).cast("long").alias("clicks"), F.lit(None).cast("long").alias("last_accessed_at")))
    return stored.select(*new.columns).unionByName(new)


def delete_codes(links: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete a set of codes. Returns (survivors, report(code, result))."""
    wanted = codes.select("code").distinct()
    survivors = links.join(wanted, "code", "left_anti")
    report = (wanted.join(links.select("code", F.lit(True).alias("_hit")), "code", "left")
              .select("code", F.when(F.col("_hit"), "deleted").otherwise("NOT_FOUND").alias("result")))
    return survivors, report


def shard_distribution(links: DataFrame, shards: int) -> DataFrame:
    """Rows per shard including empty shards, with total and one-decimal share."""
    spark = links.sparkSession
    counts = links.groupBy(shard_for("code", shards).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    # `shards` rows (<= 64 by configuration): safe to broadcast.
    all_shards = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    dist = F.broadcast(all_shards).join(counts, "shard", "left").select(
        "shard", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return dist.withColumn("total", total.cast("long")).withColumn("share", percent("n", "total"))


def shard_skew(dist: DataFrame, shards: int, tolerance_pct: float = 5.0) -> DataFrame:
    """Deviation of each shard from an even split; within-tolerance flag; shard used."""
    even = F.col("total") / F.lit(float(shards))
    dev = F.when(even == 0, F.lit(0.0)).otherwise(F.round((F.col("n") - even) / even * 100.0, 3))
    return dist.select("shard", "n", "total", dev.alias("deviation_pct"),
                       (F.abs(dev) <= F.lit(tolerance_pct)).alias("within_tolerance"),
                       (F.col("n") > 0).alias("used"))


def server_load(links: DataFrame, shards: int, servers: int) -> DataFrame:
    """Rows per physical server, where server = logical shard % servers."""
    return (links.select((shard_for("code", shards) % F.lit(servers)).cast("int").alias("server"))
            .groupBy("server").agg(F.count(F.lit(1)).alias("n")))


def link_totals(links: DataFrame, shards: int) -> DataFrame:
    """Dashboard row: links, total clicks, shards in use."""
    return links.agg(F.count(F.lit(1)).alias("links"),
                     F.coalesce(F.sum("clicks"), F.lit(0)).cast("long").alias("total_clicks"),
                     F.countDistinct(shard_for("code", shards)).alias("shards_in_use"))


def reshard_plan(links: DataFrame, from_shards: int, to_shards: int) -> DataFrame:
    """Changing the shard count N -> M: rows per (from, to), whether they move, moved share."""
    h = fnv1a32("code")
    src = (F.lit(0) if from_shards == 1 else h % F.lit(from_shards)).cast("int")
    dst = (F.lit(0) if to_shards == 1 else h % F.lit(to_shards)).cast("int")
    per = links.groupBy(src.alias("from_shard"), dst.alias("to_shard")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return per.select("from_shard", "to_shard", "n", (F.col("from_shard") != F.col("to_shard")).alias("moves"),
                      percent("n", total).alias("share"))

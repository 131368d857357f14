"""Skewed workload generation: Zipf CDF, inverse-CDF sampling, TTL jitter.

Randomness is a deterministic hash of the row id and a seed, so runs are
reproducible and every engine computes the same draws.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linklens.session import scratch_path

# Weyl-style hash to [0, 1): ((id mod 2^31) * 2654435761 + seed) mod 2^32 / 2^32
_MUL = 2654435761
_MOD = 1 << 32


def uniform(id_col, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.pmod(F.pmod(c, F.lit(1 << 31)) * F.lit(_MUL) + F.lit(seed), F.lit(_MOD)).cast("double")
            / float(_MOD))


def prefix_sum(df: DataFrame, order_col: str, value_col: str, out: str) -> DataFrame:
    """Running sum in ``order_col`` order without a single-partition window.

    Range-partition by the order column, sum each partition (one row per
    partition, bounded and broadcast), add the preceding partitions' totals to
    a within-partition running sum.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(parts, order_col).withColumn("_pid", F.spark_partition_id())
    d = d.checkpoint(eager=True)
    totals = d.groupBy("_pid").agg(F.sum(value_col).alias("_t"))
    offsets = totals.select("_pid", F.coalesce(F.sum("_t").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_off"))
    local = F.sum(value_col).over(Window.partitionBy("_pid").orderBy(order_col)
                                  .rowsBetween(Window.unboundedPreceding, 0))
    return (d.join(F.broadcast(offsets), "_pid").withColumn(out, F.col("_off") + local)
            .drop("_pid", "_off"))


def zipf_cdf(spark: SparkSession, n: int, s: float = 1.1) -> DataFrame:
    """rank (1..n) -> cumulative probability of weights 1/rank^s, plus the interval (lo, hi]."""
    ranks = spark.range(1, n + 1).select(F.col("id").alias("rank"),
                                         (F.lit(1.0) / F.pow(F.col("id").cast("double"), F.lit(s))).alias("w"))
    cum = prefix_sum(ranks, "rank", "w", "_cum")
    total = ranks.agg(F.sum("w").alias("_tot"))
    one = F.lit(1).alias("_one")
    j = cum.select("*", one).join(F.broadcast(total.select("*", one)), "_one").drop("_one")
    return j.select("rank", (F.col("_cum") / F.col("_tot")).alias("cdf"),
                    ((F.col("_cum") - F.col("w")) / F.col("_tot")).alias("lo"))


def zipf_sample(draws: DataFrame, cdf: DataFrame, u_col: str = "u") -> DataFrame:
    """Inverse CDF: the smallest rank with ``cdf >= u``, for each draw; the draws' columns, rank and its cdf.

    Draws and cdf points are range-partitioned together by value, so work and
    partitions grow with their sum wherever either crowds. Within a partition the
    smallest rank at or above a draw is a running minimum from the top; a draw
    above its partition's last point takes the first point of the partitions
    after it (one row per partition, broadcast). Draws of null, or above all points, have no rank.
    """
    spark = draws.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = F.struct(*draws.columns)
    points = cdf.select(F.col("cdf").alias("_v"), F.col("rank").alias("_rank"), F.col("cdf").alias("_cdf"),
                        F.lit(None).cast(draws.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    asked = draws.where(F.col(u_col).isNotNull()).select(
        F.col(u_col).alias("_v"), F.lit(None).cast("long").alias("_rank"), F.lit(None).cast("double").alias("_cdf"), row.alias("_row"))
    path = scratch_path(spark, f"zipf-{uuid.uuid4().hex}")
    (points.unionByName(asked).repartitionByRange(parts, "_v").withColumn("_pid", F.spark_partition_id())
     .write.parquet(path))
    d = spark.read.parquet(path)
    totals = d.groupBy("_pid").agg(F.min("_rank").alias("_r"), F.min("_cdf").alias("_c"))
    later = Window.orderBy(F.desc("_pid")).rowsBetween(Window.unboundedPreceding, -1)
    after = totals.select("_pid", F.min("_r").over(later).alias("_later_rank"), F.min("_c").over(later).alias("_later_cdf"))
    # from the top; a point comes before the draws of the same value (cdf >= u)
    above = (Window.partitionBy("_pid").orderBy(F.desc("_v"), F.col("_rank").isNull())
             .rowsBetween(Window.unboundedPreceding, 0))
    found = d.select("_pid", "_row", F.min("_rank").over(above).alias("_near_rank"), F.min("_cdf").over(above).alias("_near_cdf"))
    return (found.where(F.col("_row").isNotNull()).join(F.broadcast(after), "_pid")
            .select("_row.*", F.coalesce("_near_rank", "_later_rank").alias("rank"), F.coalesce("_near_cdf", "_later_cdf").alias("cdf"))
            .where(F.col("rank").isNotNull()))


def ttl_jitter(df: DataFrame, base_col: str, id_col: str, seed: int, spread: float = 0.1) -> DataFrame:
    """``max(1, round(base - d + u * 2d))`` with ``d = base * spread`` (half-up rounding)."""
    base = F.col(base_col).cast("double")
    delta = base * spread
    val = F.floor(base - delta + uniform(id_col, seed) * (delta * 2.0) + 0.5)
    return df.withColumn("jittered", F.greatest(F.lit(1), val.cast("long")))

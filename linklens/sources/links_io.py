"""Link table sources and sinks.

The link table is stored as parquet partitioned by logical shard
(``shard=<n>``), one folder per shard, files sorted by ``(created_at, id)`` so
row-group statistics serve keyset predicates.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linklens.functions.codecs import shard_for
from linklens.session import scratch_path

LINK_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("created_at", T.LongType(), False),
    T.StructField("expires_at", T.LongType(), True),
    T.StructField("clicks", T.LongType(), False),
    T.StructField("last_accessed_at", T.LongType(), True),
])

SHARDED_SCHEMA = T.StructType(LINK_SCHEMA.fields + [T.StructField("shard", T.IntegerType(), True)])


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Read a link table with the fixed schema (no inference)."""
    return spark.read.schema(SHARDED_SCHEMA).parquet(path)


def with_shard(df: DataFrame, shards: int, code_col: str = "code") -> DataFrame:
    return df.withColumn("shard", shard_for(code_col, shards))


def write_sharded(df: DataFrame, path: str, shards: int, files_per_shard: int | None = None) -> None:
    """Write links partitioned by logical shard.

    Rows are hash-spread over ``shards * files_per_shard`` tasks (shard plus a
    hash of the code), so one shard never lands in a single task, then sorted
    within each task by the keyset order used by listing.
    """
    spark = df.sparkSession
    if files_per_shard is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        files_per_shard = max(1, parts // shards)
    out = with_shard(df, shards)
    spread = F.pmod(F.xxhash64("code"), F.lit(files_per_shard))
    (out.repartition(shards * files_per_shard, F.col("shard"), spread)
        .sortWithinPartitions("shard", F.col("created_at").desc(), F.col("id").desc())
        .write.mode("errorifexists").partitionBy("shard").parquet(path))


def union_shards(spark: SparkSession, path: str, shards: int) -> DataFrame:
    """Read N shard folders as one relation; a shard without rows has no folder and adds nothing."""
    return read_links(spark, path).where(F.col("shard").between(0, shards - 1))


def stage_sharded(df: DataFrame, shards: int, name: str = "links") -> str:
    """Write ``df`` as a sharded table under the shared checkpoint folder; return its path."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    write_sharded(df, path, shards)
    return path


ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso_ms(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(F.timestamp_millis(c), ISO_MS)


def present_links(df: DataFrame, base_url: str) -> DataFrame:
    """Export view: short URL, ISO-8601 UTC timestamps with ms, nulls kept."""
    base = base_url.rstrip("/")
    return df.select(
        F.col("id").cast("string").alias("id"),
        "code",
        F.concat(F.lit(base + "/"), F.col("code")).alias("short_url"),
        "url",
        F.col("clicks"),
        iso_ms("created_at").alias("created_at"),
        iso_ms("expires_at").alias("expires_at"),
        iso_ms("last_accessed_at").alias("last_accessed_at"),
    )

"""Distributed ID assignment and audits.

``mint_ids`` replaces the per-node sequential generator with its closed form:
for a node's rows in arrival order (rn from 0),
``slot = rn + max_{j <= rn}(4096 * ms_j - j)``, ``ms = slot div 4096``,
``seq = slot % 4096``. Same-ms rows take consecutive sequences and the 4097th
row of a millisecond spills into the next one, exactly as the generator does.
Both running quantities are computed with the bucketed running aggregate, so
a hot node is not sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.functions.codecs import (ID_EPOCH_MS, MAX_NODE, SEQ_PER_MS, base62_decode, base62_encode, idiv, snowflake_id,
                                       snowflake_node, snowflake_seq, snowflake_ts)
from linklens.operators.sequential import running_prev


def mint_ids(df: DataFrame, node: str, ms: str, tie: str, alias: str | None = None,
             bucket_ms: int = 3_600_000) -> DataFrame:
    """Assign unique, per-node increasing IDs; code = Base62(id) unless an alias is given.

    status is ``ok``, or why a row gets no id: ``invalid_node`` (null or not 0 to
    ``MAX_NODE``: its bits would be another node's id), ``invalid_time`` (null) or
    ``before_epoch``. Such rows have null id, code, mint_ms and seq and take no sequence.
    """
    checked = df.withColumn("status", F.when(F.col(node).isNull() | ~F.col(node).between(0, MAX_NODE), "invalid_node")
                            .when(F.col(ms).isNull(), "invalid_time").when(F.col(ms) < ID_EPOCH_MS, "before_epoch").otherwise("ok"))
    df = checked.where(F.col("status") == "ok")
    d = running_prev(df, node, ms, tie, F.lit(1).cast("long"), "sum", "_cnt", bucket_ms, inclusive=True)
    d = d.withColumn("_rn", F.col("_cnt") - 1)
    d = running_prev(d, node, ms, tie, F.col(ms) * SEQ_PER_MS - F.col("_rn"), "max", "_m", bucket_ms, inclusive=True)
    slot = F.col("_rn") + F.col("_m")
    d = d.withColumn("mint_ms", idiv(slot, SEQ_PER_MS)).withColumn("seq", slot % SEQ_PER_MS)
    d = d.withColumn("id", snowflake_id("mint_ms", node, "seq"))
    code = base62_encode("id") if alias is None else F.coalesce(F.col(alias), base62_encode("id"))
    minted = d.withColumn("code", code).drop("_cnt", "_rn", "_m")
    none = {c: F.lit(None).cast(minted.schema[c].dataType) for c in ("mint_ms", "seq", "id", "code")}
    rejected = checked.where(F.col("status") != "ok").withColumns(none)
    return minted.unionByName(rejected.select(*minted.columns))


def id_audit(ids: DataFrame, node: str, id_col: str, ts: str, arrival: str, bucket: int = 1 << 20) -> DataFrame:
    """Per node: duplicates, non-increasing IDs, clock rewinds (size), busiest ms, saturated ms.

    Arrival order is ``arrival``; "earlier" state is the max ts / max id over the
    node's earlier arrivals (bucketed running max, no per-node window).
    """
    d = running_prev(ids, node, arrival, arrival, F.col(ts), "max", "_prev_ts", bucket)
    d = running_prev(d, node, arrival, arrival, F.col(id_col), "max", "_prev_id", bucket)
    per_node = d.groupBy(node).agg(
        F.count(F.lit(1)).alias("ids"),
        (F.count(F.lit(1)) - F.countDistinct(id_col)).alias("duplicates"),
        F.count_if(F.col(id_col) <= F.col("_prev_id")).alias("non_increasing"),
        F.count_if(F.col(ts) < F.col("_prev_ts")).alias("rewinds"),
        F.coalesce(F.max(F.when(F.col(ts) < F.col("_prev_ts"), F.col("_prev_ts") - F.col(ts))), F.lit(0))
         .alias("max_rewind_ms"))
    per_ms = (ids.groupBy(node, snowflake_ts(id_col).alias("_ms")).agg(F.count(F.lit(1)).alias("_n"))
              .groupBy(node).agg(F.max("_n").alias("busiest_ms_ids"),
                                 F.count_if(F.col("_n") >= SEQ_PER_MS).alias("saturated_ms")))
    return per_node.join(per_ms, node)


def decode_codes(codes: DataFrame, code_col: str = "code") -> DataFrame:
    """Code -> id -> (mint time, node, sequence)."""
    i = base62_decode(code_col)
    return codes.withColumn("id", i).withColumn("mint_ms", snowflake_ts("id")).withColumn(
        "node", snowflake_node("id")).withColumn("seq", snowflake_seq("id"))


def mint_rate(links: DataFrame, created_col: str = "created_at", hour_ms: int = 3_600_000) -> DataFrame:
    """Links minted per node per hour, with the largest mint-time vs created_at drift."""
    d = decode_codes(links)
    return d.groupBy("node", idiv("mint_ms", hour_ms).alias("hour")).agg(
        F.count(F.lit(1)).alias("minted"),
        F.max(F.col("mint_ms") - F.col(created_col)).alias("max_drift_ms"))

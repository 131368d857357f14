"""Keyset pagination, scatter-gather top-k and bulk page numbering.

Order is newest first: ``(created_at desc, id desc)``. A page is a top-k
(``TakeOrderedAndProject``: each partition keeps its best k, one merge), never a
full sort. Bulk numbering uses a range-partitioned sort plus per-partition
offsets, so no single task holds the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linklens.functions.codecs import decode_cursor_literal, encode_cursor, shard_for



def _order():
    return [F.col("created_at").desc(), F.col("id").desc()]

MAX_LIMIT = 100


def _check_limit(limit: int) -> None:
    if not isinstance(limit, int) or limit < 1 or limit > MAX_LIMIT:
        raise ValueError(f"limit must be an integer in [1, {MAX_LIMIT}], got {limit!r}")


def after_cursor(df: DataFrame, cursor: str | None) -> DataFrame:
    """Rows strictly after the cursor in list order; a malformed cursor means the first page.

    The caller's literal is decoded here, without a job, to whole numbers: predicates on the columns' own type
    reach parquet.
    """
    decoded = decode_cursor_literal(cursor) if cursor else None
    if decoded is None:
        return df
    c_at, c_id = decoded
    return df.where((F.col("created_at") < F.lit(c_at))
                    | ((F.col("created_at") == F.lit(c_at)) & (F.col("id") < F.lit(c_id))))


def list_page(df: DataFrame, limit: int = 20, cursor: str | None = None) -> DataFrame:
    """One page plus ``next_cursor`` (set on every row; null unless the page is full)."""
    _check_limit(limit)
    page = after_cursor(df, cursor).orderBy(*_order()).limit(limit)
    w_all = Window.partitionBy()  # the page holds at most `limit` (<= 100) rows
    last = Window.partitionBy().orderBy(*_order()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = F.when(F.count(F.lit(1)).over(w_all) == limit,
                 encode_cursor(F.last("created_at").over(last), F.last("id").over(last)))
    return page.withColumn("next_cursor", nxt)


def shard_topk(df: DataFrame, shards: int, limit: int = 20, cursor: str | None = None) -> DataFrame:
    """Scatter: top ``limit`` rows of every shard past the cursor; gather: merge and re-slice.

    One scan: the rank filter is a window group limit, which Spark also applies before
    the shuffle, so each task sends at most ``limit`` rows of a shard.
    """
    _check_limit(limit)
    base = after_cursor(df if "shard" in df.columns else df.withColumn("shard", shard_for("code", shards)), cursor)
    ranked = base.where(F.col("shard").between(0, shards - 1)).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("shard").orderBy(*_order())))
    return ranked.where(F.col("_rank") <= limit).drop("_rank").orderBy(*_order()).limit(limit)


def page_numbers(df: DataFrame, limit: int = 20) -> DataFrame:
    """Every row with its list position, page index and the cursor that starts its page.

    Distributed zip-with-index: a range-partitioned sort, a per-partition row
    count (one row per partition, so the offset table is bounded by the
    partition count and safe to broadcast), then position = offset + index.
    The sorted, indexed rows are checkpointed to the shared checkpoint folder
    so both branches read the same materialised partitions.
    """
    _check_limit(limit)
    sorted_df = (df.orderBy(*_order())
                 .withColumn("_mid", F.monotonically_increasing_id()))
    sorted_df = sorted_df.withColumn("_pid", F.shiftright("_mid", 33)).checkpoint(eager=True)
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    ranked = sorted_df.join(F.broadcast(offsets), "_pid").withColumn(
        "pos", F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    # The cursor that starts page p is the cursor of the last row of page p-1.
    enders = (ranked.where((F.col("pos") + 1) % limit == 0)
              .select((F.call_function("div", F.col("pos"), F.lit(limit)) + 1).alias("page"),
                      encode_cursor("created_at", "id").alias("start_cursor")))
    out = ranked.withColumn("page", F.call_function("div", F.col("pos"), F.lit(limit)))
    out = out.join(enders, "page", "left")
    return out.drop("_pid", "_mid", "_off")


def page_walk_check(table: DataFrame, paged: DataFrame) -> DataFrame:
    """Union of pages = table: rows missing, rows extra, rows repeated in the pages.

    One aggregate over both sides per (id, code), then their sums: no counts on
    the driver. Empty sides count 0.
    """
    cols = ["id", "code"]
    both = (table.select(*cols, F.lit(1).alias("_t"), F.lit(0).alias("_p"))
            .unionByName(paged.select(*cols, F.lit(0).alias("_t"), F.lit(1).alias("_p"))))
    per = both.groupBy(*cols).agg(F.sum("_t").alias("_t"), F.sum("_p").alias("_p"))
    none = F.lit(0).cast("long")

    def total(col, name):
        return F.coalesce(F.sum(col), none).alias(name)

    return per.agg(total(F.col("_t"), "table_rows"), total(F.col("_p"), "paged_rows"),
                   total(F.greatest(F.col("_t") - F.col("_p"), none), "missing"),
                   total(F.greatest(F.col("_p") - F.col("_t"), none), "extra"),
                   total(F.greatest(F.col("_p") - 1, none), "duplicates"))


def age_text(now_ms: int, ts_col: str = "created_at"):
    """``Ns ago`` / ``Nm ago`` / ``Nh ago`` / ``Nd ago``, floored, never negative."""
    s = F.greatest(F.lit(0.0), (F.lit(now_ms) - F.col(ts_col)) / 1000.0)
    return (F.when(s < 60, F.concat(F.floor(s).cast("string"), F.lit("s ago")))
            .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
            .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
            .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago"))))


def recent_links(df: DataFrame, shards: int, now_ms: int, limit: int = 20) -> DataFrame:
    """First page with shard label and age text (dashboard table)."""
    page = list_page(df, limit)
    return page.select("code", "url", "clicks", shard_for("code", shards).alias("shard"),
                       age_text(now_ms).alias("age"), "created_at", "id")

"""Request, latency and counter aggregations.

All of these are partial/final hash aggregations. Group cardinality is kept
bounded on purpose (route templates, never raw paths). Exact order statistics
use a distributed sort with per-partition offsets, never a collected group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linklens.functions.text import escape_label, percent

# --- fixed values (must equal the reference) ---
LATENCY_BUCKETS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5]
# Route templates: first matching pattern wins.
ROUTE_TEMPLATES = [
    ("^/api/links/[^/?]+$", "/api/links/:code"),
    ("^/api/links([?].*)?$", "/api/links"),
    ("^/api/shards([?].*)?$", "/api/shards"),
    ("^/health([?].*)?$", "/health"),
    ("^/ready([?].*)?$", "/ready"),
    ("^/metrics([?].*)?$", "/metrics"),
    ("^/[A-Za-z0-9_-]+$", "/:code"),
]
# -----------------------------------------------


def route_template(path_col) -> Column:
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    expr = F.lit("unmatched")
    for pattern, template in reversed(ROUTE_TEMPLATES):
        expr = F.when(c.rlike(pattern), F.lit(template)).otherwise(expr)
    return expr


def request_counts(req: DataFrame) -> DataFrame:
    return (req.withColumn("route", route_template("path"))
            .groupBy("route", "method", "status", "instance").agg(F.count(F.lit(1)).alias("n")))


def status_class(req: DataFrame) -> DataFrame:
    cls = F.call_function("div", F.col("status"), F.lit(100))
    g = req.withColumn("route", route_template("path")).groupBy("route").agg(
        *[F.count_if(cls == k).alias(f"s{k}xx") for k in (2, 3, 4, 5)])
    return g.withColumn("zero_5xx", F.col("s5xx") == 0)


def latency_histogram(req: DataFrame, by=("route", "instance")) -> DataFrame:
    """Cumulative buckets (value <= le), +Inf, sum and count per label set."""
    d = req.withColumn("route", route_template("path"))
    aggs = [F.count_if(F.col("latency_s") <= F.lit(b)).alias(f"le_{str(b).replace('.', '_')}")
            for b in LATENCY_BUCKETS]
    aggs += [F.count(F.lit(1)).alias("le_inf"), F.sum("latency_s").alias("sum_s"),
             F.count(F.lit(1)).alias("count")]
    return d.groupBy(*by).agg(*aggs).withColumn("sum_s", F.round("sum_s", 9))


def global_positions(df: DataFrame, order: list[Column]) -> DataFrame:
    """0-based position of every row in ``order``: range-partitioned sort + per-partition offsets.

    The offset table has one row per partition (bounded, broadcast). The sorted
    rows are checkpointed to the shared checkpoint folder first, so the count
    and the join see the same materialised partitions.
    """
    s = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    s = s.withColumn("_pid", F.shiftright("_mid", 33)).checkpoint(eager=True)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn("pos", F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_pid", "_mid", "_off"))


#: Bins of one round of selection, and rounds before the rest is counted value by value.
BINS, ROUNDS = 4096, 2


def exact_quantiles(df: DataFrame, group: str, value: str, qs: dict[str, float]) -> DataFrame:
    """Nearest-rank quantiles per group: the value at rank ceil(q * n); also n, max and mean.

    Distributed selection, no sort of the table: each round counts equal-width bins
    between the least and the largest value left, and keeps the bin that
    holds the wanted rank, so a smooth distribution shrinks ``BINS``-fold. What is left
    is counted by value, so equal values are one row. Every pass is a partial and
    final aggregation by group, quantile and bin; null values do not count, a group of nulls has no row.
    """
    d = df.select(group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    stats = d.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("max"),
                                 F.avg("_v").alias("mean"))
    wanted = stats.select(F.col(group).alias("_g"), "_lo", F.col("max").alias("_hi"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("q"), F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n"))).cast("long").alias("rank"))
        for name, q in qs.items()])).alias("w")).select("_g", "_lo", "_hi", "w.q", "w.rank")
    rank_before = Window.partitionBy("_g", "q").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(ROUNDS):
        width = (F.col("_hi") - F.col("_lo")) / BINS
        place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(BINS - 1))).otherwise(0)
        inside = d.join(wanted, d[group].eqNullSafe(wanted["_g"]) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        bins = inside.groupBy("_g", "q", "rank", place.cast("int").alias("_bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("c").over(rank_before), F.lit(0))
        wanted = (bins.withColumn("_before", before).where((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("c")))
                  .select("_g", "_lo", "_hi", "q", (F.col("rank") - F.col("_before")).alias("rank")))
    left = d.join(wanted, d[group].eqNullSafe(wanted["_g"]) & F.col("_v").between(F.col("_lo"), F.col("_hi")))
    values = left.groupBy("_g", "q", "rank", "_v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_g", "q").orderBy("_v"))
    found = (values.withColumn("_upto", upto).where((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("c")))
             .groupBy("_g").agg(*[F.max(F.when(F.col("q") == name, F.col("_v"))).alias(name) for name in qs]))
    return stats.join(found, stats[group].eqNullSafe(found["_g"])).drop("_g", "_lo")


def throughput(req: DataFrame) -> DataFrame:
    agg = req.agg(F.count(F.lit(1)).alias("requests"), F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("t1"),
                  F.count_if(F.col("status") >= 500).alias("errors"))
    dur = (F.col("t1") - F.col("t0")) / 1000.0
    return agg.select("requests", "errors", F.round(dur, 3).alias("duration_s"),
                      F.when(dur > 0, F.round(F.col("requests") / dur, 6)).alias("req_per_s"))


def hot_codes(counts: DataFrame, k: int) -> DataFrame:
    """Top-k codes by traffic with share and cumulative share (TakeOrdered; k rows in the window)."""
    total = counts.agg(F.sum("n").alias("_total"))
    top = counts.orderBy(F.col("n").desc(), F.col("code")).limit(k)
    w = Window.orderBy(F.col("n").desc(), F.col("code")).rowsBetween(Window.unboundedPreceding, 0)
    one = F.lit(1).alias("_one")
    return (top.select("*", one).join(F.broadcast(total.select("*", one)), "_one").drop("_one")  # 1-row total
            .withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("code"))))
            .withColumn("share", percent("n", "_total"))
            .withColumn("cum_share", percent(F.sum("n").over(w), F.col("_total")))
            .drop("_total"))


def replica_spread(req: DataFrame) -> DataFrame:
    per = req.groupBy("instance").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("instances", F.count(F.lit(1)).over(Window.partitionBy()))


def replica_agreement(pairs: DataFrame, observer: str, key: str, value: str) -> DataFrame:
    """Do all observers report the same (key -> value) set?

    Each observer's set is summarised by an order-insensitive signature (count
    and sum of 64-bit hashes of its distinct pairs): partial aggregation, no
    collected lists.
    """
    distinct = pairs.select(observer, key, value).distinct()
    sig = distinct.groupBy(observer).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum(F.xxhash64(key, value).cast("decimal(38,0)")).alias("_h"))
    return sig.agg(F.count(F.lit(1)).alias("observers"),
                   F.countDistinct("pairs", "_h").alias("distinct_signatures")).withColumn(
        "agree", F.col("distinct_signatures") <= 1)


def canonical_labels(labels_col) -> Column:
    """Label map -> ``k="v",...`` with keys sorted and values escaped (order-insensitive key)."""
    c = F.col(labels_col) if isinstance(labels_col, str) else labels_col
    entries = F.array_sort(F.map_entries(c))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit('="'), escape_label(e["value"]),
                                                                F.lit('"'))), ",")

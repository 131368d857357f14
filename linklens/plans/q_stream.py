"""Streaming queries: each runs a Structured Streaming job to completion (availableNow) over a
file source staged from the test tables, then returns the sink's contents. Each one's
oracle is the SQL of its batch twin (SURVEY §2.10, §7.4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linklens.operators import links as L
from linklens.operators import metrics as M
from linklens.operators import resolve as R
from linklens.plans import q_core, q_links, q_metrics, q_seq
from linklens.plans import views as V
from linklens.plans.catalog import ORACLE, query
from linklens.plans.sql_seq import bucket_sql, sliding_sql, ttl_sql
from linklens.plans.views import with_views
from linklens.session import scratch_path
from linklens.sources.versions import VersionedLinks
from linklens.streaming import jobs as J

LATE_DELAY_MS = 3_600_000
FLUSH_CODES = 100
SHARDS = 16


def _staged(spark, sf, df, name, late_replay=False, whole_chunks=False, few=False):
    """``few``: for flushes that read or rewrite a whole table, the triggers are ``J.MAX_BATCHES`` at most."""
    path = J.stage_source(df, "ts_ms", name, one_file=whole_chunks)
    if late_replay:
        first = df.agg(F.min(F.call_function("div", F.col("ts_ms"), F.lit(J.CHUNK_MS)))).first()[0]
        (df.where((F.call_function("div", F.col("ts_ms"), F.lit(J.CHUNK_MS)) == first) & (F.col("tie") % 10 == 0))
         .write.mode("append").parquet(path))
    return J.click_source(spark, path, df.schema, J.files_per_trigger(spark, path) if few else 1)


def _clicks(spark, sf):
    return V.clicks(spark, sf)


@query("click_source", with_views("SELECT code, ts_ms, tie, instance FROM clicks", "clicks"))
def q_click_source(spark, sf):
    s = _staged(spark, sf, _clicks(spark, sf), "clicks")
    out = J.run_batches(s, "click_source", "append")
    return spark.read.parquet(out).select("code", "ts_ms", "tie", "instance")


@query("stream_click_counts", with_views("""
    SELECT (ts_ms // 5000) * 5000 AS window_start, code, count(*) AS count, max(ts_ms) AS last_accessed_at
    FROM clicks GROUP BY 1, 2""", "clicks"))
def q_stream_click_counts(spark, sf):
    s = _staged(spark, sf, _clicks(spark, sf), "counts")
    out = J.run_batches(s, "click_counts", "append", J.click_counts())
    return J.total_counts(spark.read.parquet(out))


@query("stream_apply_clicks", ORACLE["apply_clicks"])
def q_stream_apply_clicks(spark, sf):
    s = _staged(spark, sf, _clicks(spark, sf), "apply", few=True)
    links = V.request_links(spark, sf)
    table = VersionedLinks(spark, scratch_path(spark, f"links-{uuid.uuid4().hex}"), SHARDS, links.schema)
    table.create(links)
    J.run_batches(s, "apply_clicks", "append", J.commit_flushes(table))
    return table.read().drop("shard")


@query("stream_flush_summary", with_views(f"""
    SELECT CAST(dense_rank() OVER (ORDER BY ts_ms // {J.CHUNK_MS}) - 1 AS BIGINT) AS batch_id, count(DISTINCT code) AS codes,
           count(*) AS clicks
    FROM clicks GROUP BY ts_ms // {J.CHUNK_MS}""", "clicks"))
def q_stream_flush_summary(spark, sf):
    s = _staged(spark, sf, _clicks(spark, sf), "summary", whole_chunks=True)
    out = J.run_batches(s, "flush_summary", "append", J.flush_summary)
    return spark.read.parquet(out).select(F.col("batch_id").cast("bigint").alias("batch_id"), "codes", "clicks")


@query("stream_buffer_bound", with_views(f"""
    SELECT CAST(dense_rank() OVER (ORDER BY ts_ms // {J.CHUNK_MS}) - 1 AS BIGINT) AS batch_id, count(*) AS rows
    FROM clicks GROUP BY ts_ms // {J.CHUNK_MS}""", "clicks"))
def q_stream_buffer_bound(spark, sf):
    """One file set per trigger bounds the work (rows) of every flush."""
    s = _staged(spark, sf, _clicks(spark, sf), "bound", whole_chunks=True)
    out = J.run_batches(s, "buffer_bound", "append",
                        lambda b, i: b.agg(F.count(F.lit(1)).alias("rows")).withColumn("batch_id", F.lit(i)))
    return spark.read.parquet(out).select(F.col("batch_id").cast("bigint").alias("batch_id"), "rows")


@query("stream_flush_totals", with_views("""
    SELECT code, count(*) AS count, max(ts_ms) AS last_accessed_at FROM clicks GROUP BY code""", "clicks"))
def q_stream_flush_totals(spark, sf):
    """Per code, what all flushes together wrote: equal to one batch, wherever the micro-batches were cut."""
    s = _staged(spark, sf, _clicks(spark, sf), "totals")
    out = J.run_batches(s, "flush_totals", "append", J.flush_deltas)
    return spark.read.parquet(out).groupBy("code").agg(F.sum("count").alias("count"),
                                                       F.max("last_accessed_at").alias("last_accessed_at"))


@query("stream_bounded_flushes", with_views("""
    SELECT count(*) AS clicks, CAST(0 AS BIGINT) AS over_bound FROM clicks""", "clicks"))
def q_stream_bounded_flushes(spark, sf):
    """Clicks in all flushes, and the flushes of more than ``FLUSH_CODES`` distinct codes (none)."""
    s = _staged(spark, sf, _clicks(spark, sf), "flushes")
    out = J.run_batches(s, "bounded_flushes", "append", J.bounded_flushes(FLUSH_CODES))
    return spark.read.parquet(out).agg(F.coalesce(F.sum("clicks"), F.lit(0)).cast("long").alias("clicks"),
                                       F.count_if(F.col("codes") > FLUSH_CODES).alias("over_bound"))


@query("stream_late_clicks", with_views(f"""
    SELECT false AS late, count(*) AS clicks FROM clicks
    UNION ALL
    SELECT true, count(*) FROM clicks
    WHERE ts_ms // {J.CHUNK_MS} = (SELECT min(ts_ms // {J.CHUNK_MS}) FROM clicks) AND tie % 10 = 0""", "clicks"))
def q_stream_late_clicks(spark, sf):
    s = _staged(spark, sf, _clicks(spark, sf), "late", late_replay=True)
    out = J.run_batches(s, "late_clicks", "append", J.late_split(LATE_DELAY_MS, scratch_path(spark, f"marks-{uuid.uuid4().hex}")))
    per = spark.read.parquet(out).groupBy("late").agg(F.sum("clicks").cast("long").alias("clicks"))
    flags = spark.createDataFrame([(False,), (True,)], "late boolean")  # both rows always reported
    return flags.join(per, "late", "left").select("late", F.coalesce("clicks", F.lit(0)).cast("long").alias("clicks"))


@query("stream_click_enrich", ORACLE["click_enrich"])
def q_stream_click_enrich(spark, sf):
    s = _staged(spark, sf, _clicks(spark, sf), "enrich", few=True)
    links = J.materialised(V.links(spark, sf).select("code", "url", "id"), "enrich-links")
    enriched = R.click_enrich(s, links, shards=4)
    out = J.run_batches(enriched, "click_enrich", "append")
    return spark.read.parquet(out).select("tie", "code", "target", "link_id", "shard")


@query("stream_resolve", ORACLE["resolve_requests"])
def q_stream_resolve(spark, sf):
    reqs = V.requests(spark, sf).where(F.col("tier") == "redirect")
    s = _staged(spark, sf, reqs, "resolve", few=True)
    links = J.materialised(V.request_links(spark, sf).select("code", "url", "expires_at"), "resolve-links")
    res = R.resolve_requests(s, links)
    out = J.run_batches(res.select("event_id", "code", "instance", "outcome", "http_status", "target"),
                        "resolve", "append")
    return spark.read.parquet(out).select("event_id", "code", "instance", "outcome", "http_status", "target")


@query("stream_latency_histogram", with_views(f"""
    SELECT (ts_ms // 3600000) * 3600000 AS window_start, route, {q_metrics._HIST_COLS}, count(*) AS count
    FROM (SELECT {q_metrics.ROUTE_SQL} AS route, ts_ms, latency_s FROM requests) GROUP BY 1, 2""", "requests"))
def q_stream_latency_histogram(spark, sf):
    reqs = V.requests(spark, sf).withColumn("route", M.route_template("path")).select("route", "ts_ms", "tie",
                                                                                     "latency_s")
    s = _staged(spark, sf, reqs, "latency")
    aggs = [F.count_if(F.col("latency_s") <= F.lit(b)).alias(f"le_{str(b).replace('.', '_')}")
            for b in M.LATENCY_BUCKETS] + [F.count(F.lit(1)).alias("count")]
    out = J.run_batches(s, "latency_hist", "append", lambda batch, _: batch.groupBy(
        J.window_start(3_600_000).alias("window_start"), "route").agg(*aggs))
    names = [f"le_{str(b).replace('.', '_')}" for b in M.LATENCY_BUCKETS] + ["count"]
    return spark.read.parquet(out).groupBy("window_start", "route").agg(*[F.sum(n).alias(n) for n in names])


def _limit_requests(spark, sf):
    return V.requests(spark, sf).select("event_id", "client", "ts_ms", "tie")


def _limit_stream(spark, sf, name):
    return _staged(spark, sf, _limit_requests(spark, sf), name)


@query("stream_sliding_limit", ORACLE["sliding_window_limit"])
def q_stream_sliding(spark, sf):
    """A client's rows reach the stream in time order, also where a chunk is several files. A micro-batch rewrites the logs
    that it touches, so the triggers are few, but of ``J.MAX_FILES`` files at most."""
    r = _limit_requests(spark, sf)
    path = J.stage_source(r, "ts_ms", "slide", by=J.limit_bucket("client"), order=("ts_ms", "tie"))
    s = J.click_source(spark, path, r.schema, min(J.MAX_FILES, J.files_per_trigger(spark, path)))
    out = J.run_batches(J.stream_sliding_limit(s, "client", q_seq.SLIDE_LIMIT, q_seq.SLIDE_WINDOW_MS),
                        "sliding", "append")
    return spark.read.parquet(out).select("event_id", "allowed", "remaining", "reset_at", "retry_after_ms")


@query("stream_token_bucket", ORACLE["token_bucket_limit"])
def q_stream_bucket(spark, sf):
    s = _limit_stream(spark, sf, "bucket")
    out = J.run_batches(J.stream_token_bucket(s, "client", q_seq.BUCKET_CAPACITY, q_seq.BUCKET_REFILL),
                        "bucket", "append")
    return spark.read.parquet(out).select("event_id", "allowed", "remaining", "reset_at", "retry_after_ms")


@query("stream_ttl_first_touch", with_views(f"""
    SELECT event_id, leader_ts FROM ({ttl_sql(f'''
    SELECT code AS key, ts_ms AS ts, tie, CAST({q_seq.TTL_MS} AS BIGINT) AS ttl, 'read' AS kind,
           NULL::BIGINT AS tcap, event_id AS id FROM requests WHERE tier = 'redirect' ''', "id AS event_id")})
    WHERE is_fill""", "requests"))
def q_stream_ttl(spark, sf):
    r = V.requests(spark, sf).where(F.col("tier") == "redirect").select("event_id", "code", "ts_ms", "tie")
    s = _staged(spark, sf, r, "ttl")
    out = J.run_batches(J.stream_ttl_first_touch(s, "code", q_seq.TTL_MS), "ttl", "append")
    return spark.read.parquet(out).select("event_id", "leader_ts")

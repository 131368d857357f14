"""Metric queries: request tallies, latency, counters, exposition."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from linklens.operators import metrics as M
from linklens.operators import resolve as R
from linklens.plans import q_cache
from linklens.plans import views as V
from linklens.plans.catalog import query
from linklens.plans.views import with_views
from linklens.session import scratch_path
from linklens.sources import exposition as X

# --- fixed query parameters ---
HOT_K = 10
HOUR_MS = 3_600_000
SNAP_BEFORE_MS = 1704844800000  # 2024-01-10T00:00:00Z
SNAP_AFTER_MS = 1705708800000  # 2024-01-20T00:00:00Z
PROBE_SHARDS = 4
SLO = {"p99_latency_ms": 25.0, "req_per_s": 5000.0, "hit_pct": 95.0, "errors_5xx": 0.0}
# ------------------------------

ROUTE_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(path, '{p}') THEN '{t}'" for p, t in M.ROUTE_TEMPLATES) + " ELSE 'unmatched' END"


def _req(spark, sf):
    return V.requests(spark, sf)


@query("request_counts", with_views(f"""
    SELECT {ROUTE_SQL} AS route, method, status, instance, count(*) AS n FROM requests GROUP BY ALL""",
    "requests"))
def q_request_counts(spark, sf):
    return M.request_counts(_req(spark, sf))


@query("status_class", with_views(f"""
    SELECT route, count(*) FILTER (WHERE status // 100 = 2) AS s2xx, count(*) FILTER (WHERE status // 100 = 3) AS s3xx,
           count(*) FILTER (WHERE status // 100 = 4) AS s4xx, count(*) FILTER (WHERE status // 100 = 5) AS s5xx,
           count(*) FILTER (WHERE status // 100 = 5) = 0 AS zero_5xx
    FROM (SELECT {ROUTE_SQL} AS route, status FROM requests) GROUP BY route""", "requests"))
def q_status_class(spark, sf):
    return M.status_class(_req(spark, sf))


_HIST_COLS = ", ".join(
    f"count(*) FILTER (WHERE latency_s <= {b}) AS le_{str(b).replace('.', '_')}" for b in M.LATENCY_BUCKETS)


@query("latency_histogram", with_views(f"""
    SELECT route, instance, {_HIST_COLS}, count(*) AS le_inf, round(sum(latency_s), 9) AS sum_s, count(*) AS count
    FROM (SELECT {ROUTE_SQL} AS route, instance, latency_s FROM requests) GROUP BY route, instance""", "requests"))
def q_latency_histogram(spark, sf):
    return M.latency_histogram(_req(spark, sf))


_Q_SQL = """
    WITH r AS (SELECT {ROUTE} AS route, latency_s,
                      row_number() OVER (PARTITION BY {ROUTE} ORDER BY latency_s, tie) AS rk,
                      count(*) OVER (PARTITION BY {ROUTE}) AS n FROM requests)
    SELECT route, n, max(latency_s) AS max, avg(latency_s) AS mean,
           max(latency_s) FILTER (WHERE rk = greatest(1, CAST(ceil(0.5 * n) AS BIGINT))) AS p50,
           max(latency_s) FILTER (WHERE rk = greatest(1, CAST(ceil(0.99 * n) AS BIGINT))) AS p99
    FROM r GROUP BY route, n""".replace("{ROUTE}", ROUTE_SQL)


@query("latency_quantiles", with_views(_Q_SQL, "requests"))
def q_latency_quantiles(spark, sf):
    r = _req(spark, sf).withColumn("route", M.route_template("path"))
    return M.exact_quantiles(r, "route", "latency_s", {"p50": 0.5, "p99": 0.99})


@query("latency_quantiles_approx")
def q_latency_quantiles_approx(spark, sf):
    """Scale variant: percentile_approx (bounded sketch per group), no oracle (approximate)."""
    r = _req(spark, sf).withColumn("route", M.route_template("path"))
    return r.groupBy("route").agg(F.count(F.lit(1)).alias("n"),
                                  F.percentile_approx("latency_s", [0.5, 0.99], 10000).alias("p"),
                                  F.max("latency_s").alias("max"), F.avg("latency_s").alias("mean"))


_TP_SQL = """
    SELECT count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS errors,
           round((max(ts_ms) - min(ts_ms)) / 1000.0, 3) AS duration_s,
           CASE WHEN max(ts_ms) > min(ts_ms) THEN round(count(*) / ((max(ts_ms) - min(ts_ms)) / 1000.0), 6) END
             AS req_per_s
    FROM requests"""


@query("throughput", with_views(_TP_SQL, "requests"))
def q_throughput(spark, sf):
    return M.throughput(_req(spark, sf))


@query("slo_report", with_views(f"""
    WITH q AS (SELECT max(p99) AS p99 FROM ({_Q_SQL.replace("PARTITION BY " + ROUTE_SQL, "PARTITION BY 1")}) ),
    t AS ({_TP_SQL}),
    h AS (SELECT effectiveness AS hit FROM ({q_cache.EFFECTIVENESS_SQL})),
    v AS (SELECT 'p99_latency_ms' AS target, round(q.p99 * 1000.0, 6) AS actual, {SLO['p99_latency_ms']} AS threshold
          FROM q
          UNION ALL SELECT 'req_per_s', t.req_per_s, {SLO['req_per_s']} FROM t
          UNION ALL SELECT 'hit_pct', h.hit, {SLO['hit_pct']} FROM h
          UNION ALL SELECT 'errors_5xx', CAST(t.errors AS DOUBLE), {SLO['errors_5xx']} FROM t)
    SELECT target, actual, CAST(threshold AS DOUBLE) AS threshold,
           CASE WHEN target = 'p99_latency_ms' THEN actual < threshold
                WHEN target = 'errors_5xx' THEN actual <= threshold
                WHEN target = 'hit_pct' THEN actual > threshold
                ELSE actual >= threshold END AS pass
    FROM v""", "requests", "request_links"))
def q_slo_report(spark, sf):
    r = _req(spark, sf).withColumn("all", F.lit(1))
    q = M.exact_quantiles(r, "all", "latency_s", {"p99": 0.99}).select(
        F.round(F.col("p99") * 1000.0, 6).alias("p99_latency_ms"))
    t = M.throughput(_req(spark, sf)).select("req_per_s", F.col("errors").cast("double").alias("errors_5xx"))
    h = q_cache.q_cache_effectiveness(spark, sf).select(F.col("effectiveness").alias("hit_pct"))
    def one(frame, name):
        return frame.select(F.lit(name).alias("target"), F.col(name).cast("double").alias("actual"),
                            F.lit(SLO[name]).cast("double").alias("threshold"))

    stacked = (one(q, "p99_latency_ms").unionByName(one(t, "req_per_s")).unionByName(one(h, "hit_pct"))
               .unionByName(one(t, "errors_5xx")))
    passed = (F.when(F.col("target") == "p99_latency_ms", F.col("actual") < F.col("threshold"))
              .when(F.col("target") == "errors_5xx", F.col("actual") <= F.col("threshold"))
              .when(F.col("target") == "hit_pct", F.col("actual") > F.col("threshold"))
              .otherwise(F.col("actual") >= F.col("threshold")))
    return stacked.withColumn("pass", passed)


@query("hot_codes", with_views(f"""
    WITH c AS (SELECT code, count(*) AS n FROM clicks GROUP BY code),
    t AS (SELECT sum(n) AS total FROM c),
    top AS (SELECT * FROM c ORDER BY n DESC, code LIMIT {HOT_K})
    SELECT code, n, row_number() OVER (ORDER BY n DESC, code) AS rank,
           floor(CAST(n AS DOUBLE) / total * 1000.0 + 0.5) / 10.0 AS share,
           floor(CAST(sum(n) OVER (ORDER BY n DESC, code ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
                 / total * 1000.0 + 0.5) / 10.0 AS cum_share
    FROM top, t""", "clicks"))
def q_hot_codes(spark, sf):
    counts = V.clicks(spark, sf).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return M.hot_codes(counts, HOT_K)


@query("replica_spread", with_views("""
    SELECT instance, count(*) AS n, count(*) OVER () AS instances FROM requests GROUP BY instance""", "requests"))
def q_replica_spread(spark, sf):
    return M.replica_spread(_req(spark, sf))


@query("replica_agreement", with_views("""
    WITH p AS (SELECT DISTINCT r.instance, r.code, l.url FROM requests r JOIN request_links l ON r.code = l.code
               WHERE r.tier = 'redirect'),
    s AS (SELECT instance, count(*) AS pairs, string_agg(code || '>' || url, '|' ORDER BY code, url) AS sig
          FROM p GROUP BY instance)
    SELECT count(*) AS observers, count(DISTINCT sig) AS distinct_signatures, count(DISTINCT sig) <= 1 AS agree
    FROM s""", "requests", "request_links"))
def q_replica_agreement(spark, sf):
    r = _req(spark, sf).where(F.col("tier") == "redirect")
    pairs = r.join(V.request_links(spark, sf).select("code", "url"), "code")
    return M.replica_agreement(pairs, "instance", "code", "url")


@query("dependency_health", with_views(f"""
    WITH p AS (SELECT ts_ms // {HOUR_MS} AS round, event_id % {PROBE_SHARDS} AS shard, bool_and(ok) AS healthy
               FROM requests GROUP BY 1, 2)
    SELECT round, count(*) FILTER (WHERE healthy) AS healthy_shards, count(*) AS total_shards,
           count(*) >= 1 AND count(*) FILTER (WHERE healthy) = count(*) AS up
    FROM p GROUP BY round""", "requests"))
def q_dependency_health(spark, sf):
    r = _req(spark, sf)
    probes = r.groupBy(F.call_function("div", F.col("ts_ms"), F.lit(HOUR_MS)).alias("round"),
                       (F.col("event_id") % PROBE_SHARDS).alias("shard")).agg(F.bool_and("ok").alias("healthy"))
    return probes.groupBy("round").agg(
        F.count_if("healthy").alias("healthy_shards"), F.count(F.lit(1)).alias("total_shards")).withColumn(
        "up", (F.col("total_shards") >= 1) & (F.col("healthy_shards") == F.col("total_shards")))


# ---- counters from metric samples ----

def _increments(spark, sf):
    """Counter increments with label maps whose key order varies by row."""
    r = _req(spark, sf).withColumn("route", M.route_template("path"))
    fwd = F.create_map(F.lit("route"), F.col("route"), F.lit("method"), F.col("method"),
                       F.lit("status"), F.col("status").cast("string"), F.lit("instance"), F.col("instance").cast("string"))
    rev = F.create_map(F.lit("instance"), F.col("instance").cast("string"), F.lit("status"), F.col("status").cast("string"),
                       F.lit("method"), F.col("method"), F.lit("route"), F.col("route"))
    return r.select(F.lit("linklens_http_requests_total").alias("name"),
                    F.when(F.col("event_id") % 2 == 0, fwd).otherwise(rev).alias("labels"),
                    F.lit(1.0).alias("value"), "ts_ms", "tie", "instance", "route", "method", "status")


_LABELS_SQL = ("'instance=\"' || CAST(instance AS VARCHAR) || '\",method=\"' || method || '\",route=\"' || route "
               "|| '\",status=\"' || CAST(status AS VARCHAR) || '\"'")
_SERIES_SQL = ("'method=\"' || method || '\",route=\"' || route || '\",status=\"' || CAST(status AS VARCHAR) || '\"'")


@query("counter_sum", with_views(f"""
    SELECT 'linklens_http_requests_total' AS name, {_LABELS_SQL} AS labels, sum(1.0) AS value
    FROM (SELECT {ROUTE_SQL} AS route, method, status, instance FROM requests) GROUP BY 1, 2""", "requests"))
def q_counter_sum(spark, sf):
    inc = _increments(spark, sf)
    return inc.groupBy("name", M.canonical_labels("labels").alias("labels")).agg(F.sum("value").alias("value"))


@query("gauge_latest", with_views("""
    SELECT instance, first(latency_s ORDER BY ts_ms DESC, tie DESC) AS value, max(ts_ms) AS ts_ms
    FROM requests GROUP BY instance""", "requests"))
def q_gauge_latest(spark, sf):
    r = _req(spark, sf)
    return r.groupBy("instance").agg(F.max_by("latency_s", F.struct("ts_ms", "tie")).alias("value"),
                                     F.max("ts_ms").alias("ts_ms"))


def scrapes(spark, sf):
    """Hourly scrapes per instance: cumulative request counter per series (series excludes instance)."""
    inc = _increments(spark, sf)
    per = (inc.groupBy("instance", "route", "method", "status",
                       F.call_function("div", F.col("ts_ms"), F.lit(HOUR_MS)).alias("hour"))
           .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("instance", "route", "method", "status").orderBy("hour")
    series = F.concat(F.lit('method="'), F.col("method"), F.lit('",route="'), F.col("route"),
                      F.lit('",status="'), F.col("status").cast("string"), F.lit('"'))
    return per.select("instance", series.alias("series"), ((F.col("hour") + 1) * HOUR_MS).alias("scrape_ms"),
                      F.sum("n").over(w).cast("double").alias("value"))


_SCRAPES_SQL = f"""
    SELECT instance, series, scrape_ms,
           CAST(sum(n) OVER (PARTITION BY instance, series ORDER BY scrape_ms) AS DOUBLE) AS value
    FROM (SELECT instance, {_SERIES_SQL} AS series, (ts_ms // {HOUR_MS} + 1) * {HOUR_MS} AS scrape_ms, count(*) AS n
          FROM (SELECT {ROUTE_SQL} AS route, method, status, instance, ts_ms FROM requests) GROUP BY 1, 2, 3)"""


@query("cluster_counters", with_views(f"""
    SELECT series, sum(v) AS value, count(*) AS instances
    FROM (SELECT instance, series, max(value) AS v FROM ({_SCRAPES_SQL}) GROUP BY 1, 2) GROUP BY series""",
    "requests"))
def q_cluster_counters(spark, sf):
    per = scrapes(spark, sf).groupBy("instance", "series").agg(F.max("value").alias("v"))
    return per.groupBy("series").agg(F.sum("v").alias("value"), F.count(F.lit(1)).alias("instances"))


def _snapshot(sc, at_ms):
    s = sc.where(F.col("scrape_ms") <= at_ms).groupBy("instance", "series").agg(F.max("value").alias("v"))
    return s.groupBy("series").agg(F.sum("v").alias("v"))


@query("counter_delta", with_views(f"""
    WITH s AS ({_SCRAPES_SQL}),
    b AS (SELECT series, sum(v) AS v FROM (SELECT instance, series, max(value) AS v FROM s
          WHERE scrape_ms <= {SNAP_BEFORE_MS} GROUP BY 1, 2) GROUP BY series),
    a AS (SELECT series, sum(v) AS v FROM (SELECT instance, series, max(value) AS v FROM s
          WHERE scrape_ms <= {SNAP_AFTER_MS} GROUP BY 1, 2) GROUP BY series)
    SELECT coalesce(a.series, b.series) AS series, coalesce(a.v, 0.0) - coalesce(b.v, 0.0) AS delta
    FROM a FULL OUTER JOIN b ON a.series = b.series""", "requests"))
def q_counter_delta(spark, sf):
    sc = scrapes(spark, sf)
    b, a = _snapshot(sc, SNAP_BEFORE_MS), _snapshot(sc, SNAP_AFTER_MS)
    j = a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), "series", "full_outer")
    return j.select("series", (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("delta"))


@query("counter_increase", with_views(f"""
    WITH s AS ({_SCRAPES_SQL}),
    d AS (SELECT instance, series, value - lag(value) OVER (PARTITION BY instance, series ORDER BY scrape_ms) AS dv
          FROM s)
    SELECT instance, series, coalesce(sum(dv) FILTER (WHERE dv > 0), 0.0) AS increase,
           count(*) FILTER (WHERE dv < 0) AS decreases, count(*) AS scrapes
    FROM d GROUP BY instance, series""", "requests"))
def q_counter_increase(spark, sf):
    sc = scrapes(spark, sf)
    w = Window.partitionBy("instance", "series").orderBy("scrape_ms")
    d = sc.withColumn("dv", F.col("value") - F.lag("value").over(w))
    return d.groupBy("instance", "series").agg(
        F.coalesce(F.sum(F.when(F.col("dv") > 0, F.col("dv"))), F.lit(0.0)).alias("increase"),
        F.count_if(F.col("dv") < 0).alias("decreases"), F.count(F.lit(1)).alias("scrapes"))


# ---- exposition text ----

def _samples(spark, sf):
    """Final registry state: request counter and duration histogram, per label set."""
    r = _req(spark, sf).withColumn("route", M.route_template("path"))
    counter = (r.groupBy("route", "method", "status", "instance").agg(F.count(F.lit(1)).cast("double").alias("value"))
               .select(F.lit(X.REQUESTS).alias("metric"),
                       F.create_map(F.lit("route"), F.col("route"), F.lit("method"), F.col("method"),
                                    F.lit("status"), F.col("status").cast("string"),
                                    F.lit("instance"), F.col("instance").cast("string")).alias("labels"),
                       "value"))
    hist = M.latency_histogram(r, by=("route", "instance"))
    labels = F.create_map(F.lit("route"), F.col("route"), F.lit("instance"), F.col("instance").cast("string"))
    return X.scalar_samples(counter, "counter").unionByName(X.histogram_samples(hist, X.DURATION, labels))


@query("exposition_write", with_views(f"""
    WITH c AS (SELECT {ROUTE_SQL} AS route, method, status, instance, count(*) AS n FROM requests GROUP BY ALL),
    h AS (SELECT {ROUTE_SQL} AS route, instance, latency_s FROM requests),
    hb AS (SELECT route, instance, lbl AS le, count(*) FILTER (WHERE latency_s <= b) AS n
           FROM h, (SELECT * FROM (VALUES {", ".join(f"({b}::DOUBLE, '{b}')" for b in M.LATENCY_BUCKETS)}) t(b, lbl)) GROUP BY ALL),
    hs AS (SELECT route, instance, count(*) AS n, round(sum(latency_s), 6) AS s FROM h GROUP BY ALL),
    lab AS (SELECT route, instance, 'instance="' || CAST(instance AS VARCHAR) || '",route="'
                   || replace(replace(replace(route, '\\', '\\\\'), chr(10), '\\n'), '"', '\\"') || '"' AS k FROM hs)
    SELECT '{X.REQUESTS}' AS metric, '# HELP {X.REQUESTS} {X.HELP[X.REQUESTS]}' AS line
    UNION ALL SELECT '{X.REQUESTS}', '# TYPE {X.REQUESTS} counter'
    UNION ALL SELECT '{X.REQUESTS}', '{X.REQUESTS}{{instance="' || CAST(instance AS VARCHAR) || '",method="' || method
              || '",route="' || route || '",status="' || CAST(status AS VARCHAR) || '"}} ' || CAST(n AS VARCHAR) FROM c
    UNION ALL SELECT '{X.DURATION}', '# HELP {X.DURATION} {X.HELP[X.DURATION]}'
    UNION ALL SELECT '{X.DURATION}', '# TYPE {X.DURATION} histogram'
    UNION ALL SELECT '{X.DURATION}', '{X.DURATION}_bucket{{' || lab.k || ',le="' || hb.le
              || '"}} ' || CAST(hb.n AS VARCHAR) FROM hb JOIN lab USING (route, instance)
    UNION ALL SELECT '{X.DURATION}', '{X.DURATION}_bucket{{' || lab.k || ',le="+Inf"}} ' || CAST(hs.n AS VARCHAR)
              FROM hs JOIN lab USING (route, instance)
    UNION ALL SELECT '{X.DURATION}', '{X.DURATION}_sum{{' || lab.k || '}} ' || CAST(hs.s AS VARCHAR)
              FROM hs JOIN lab USING (route, instance)
    UNION ALL SELECT '{X.DURATION}', '{X.DURATION}_count{{' || lab.k || '}} ' || CAST(hs.n AS VARCHAR)
              FROM hs JOIN lab USING (route, instance)""", "requests"))
def q_exposition_write(spark, sf):
    return X.render(_samples(spark, sf))


@query("exposition_read", with_views(f"""
    SELECT '{X.REQUESTS}' AS name, 'instance="' || CAST(instance AS VARCHAR) || '",method="' || method
           || '",route="' || route || '",status="' || CAST(status AS VARCHAR) || '"' AS labels,
           CAST(count(*) AS DOUBLE) AS value
    FROM (SELECT {ROUTE_SQL} AS route, method, status, instance FROM requests) GROUP BY ALL
    UNION ALL
    SELECT '{X.DURATION}_count', 'instance="' || CAST(instance AS VARCHAR) || '",route="' || route || '"',
           CAST(count(*) AS DOUBLE)
    FROM (SELECT {ROUTE_SQL} AS route, instance FROM requests) GROUP BY ALL
    UNION ALL
    SELECT '{X.DURATION}_sum', 'instance="' || CAST(instance AS VARCHAR) || '",route="' || route || '"',
           round(sum(latency_s), 6)
    FROM (SELECT {ROUTE_SQL} AS route, instance, latency_s FROM requests) GROUP BY ALL
    UNION ALL
    SELECT '{X.DURATION}_bucket', 'instance="' || CAST(instance AS VARCHAR) || '",le="' || lbl || '",route="' || route || '"',
           CAST(count(*) FILTER (WHERE latency_s <= b) AS DOUBLE)
    FROM (SELECT {ROUTE_SQL} AS route, instance, latency_s FROM requests),
         (SELECT * FROM (VALUES {", ".join(f"({b}::DOUBLE, '{b}')" for b in M.LATENCY_BUCKETS)}, ('inf'::DOUBLE, '+Inf')) t(b, lbl))
    GROUP BY instance, route, lbl""", "requests"))
def q_exposition_read(spark, sf):
    return _read_back(spark, _samples(spark, sf))


def _read_back(spark, samples):
    path = scratch_path(spark, f"exposition-{uuid.uuid4().hex}")
    X.render(samples).select("line").write.text(path)
    return X.parse(spark.read.text(path)).select("name", M.canonical_labels("labels").alias("labels"), "value")


@query("exposition_gauges", with_views(f"""
    SELECT '{X.LATEST}' AS name, 'instance="' || CAST(instance AS VARCHAR) || '"' AS labels,
           first(latency_s ORDER BY ts_ms DESC, tie DESC) AS value FROM requests GROUP BY instance
    UNION ALL SELECT '{X.TOTAL}', '', CAST(count(*) AS DOUBLE) FROM requests""", "requests"))
def q_exposition_gauges(spark, sf):
    """A gauge for each instance and a counter without labels, written as text and read back."""
    latest = q_gauge_latest(spark, sf).select(
        F.lit(X.LATEST).alias("metric"), F.create_map(F.lit("instance"), F.col("instance").cast("string")).alias("labels"), "value")
    total = _req(spark, sf).agg(F.count(F.lit(1)).alias("value")).select(
        F.lit(X.TOTAL).alias("metric"), F.lit(None).cast("map<string,string>").alias("labels"), "value")
    return _read_back(spark, X.scalar_samples(latest, "gauge").unionByName(X.scalar_samples(total, "counter")))

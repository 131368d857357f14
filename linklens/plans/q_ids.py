"""ID minting/audit and workload queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linklens.operators import ids as D
from linklens.operators import workload as W
from linklens.plans import views as V
from linklens.plans.catalog import query
from linklens.plans.views import sql_base62, with_views

# --- fixed query parameters ---
NODES = 1024
ZIPF_S = 1.1
SEED = 42
BASE_TTL_S = 3600
HOUR_MS = 3_600_000
# ------------------------------


def _minted(spark, sf):
    r = V.requests(spark, sf).select("event_id", (F.col("client") % NODES).alias("node"), "ts_ms")
    return D.mint_ids(r, "node", "ts_ms", "event_id")


_MINT_SQL = f"""
    WITH b AS (SELECT event_id, client % {NODES} AS node, ts_ms,
                      row_number() OVER (PARTITION BY client % {NODES} ORDER BY ts_ms, event_id) - 1 AS rn
               FROM requests),
    s AS (SELECT *, rn + max(ts_ms * 4096 - rn) OVER (PARTITION BY node ORDER BY ts_ms, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS slot FROM b),
    m AS (SELECT event_id, node, ts_ms, slot // 4096 AS mint_ms, slot % 4096 AS seq FROM s),
    i AS (SELECT *, ((mint_ms - 1704067200000) << 22) | (node << 12) | seq AS id FROM m)"""


@query("mint_ids", with_views(_MINT_SQL + f"""
    SELECT event_id, id, {sql_base62('id')} AS code, mint_ms, seq FROM i""", "requests"))
def q_mint_ids(spark, sf):
    return _minted(spark, sf).select("event_id", "id", "code", "mint_ms", "seq")


#: Nodes beyond the ten bits and times before the epoch, for the checked minting.
NODE_STEP, EARLY_MS = 8, 1_000 * 86_400_000


@query("mint_status", with_views(f"""
    WITH n AS (SELECT event_id, client * {NODE_STEP} - 4 AS node,
                      ts_ms - CASE WHEN client % 7 = 0 THEN {EARLY_MS} ELSE 0 END AS ts_ms FROM requests),
    st AS (SELECT *, CASE WHEN node < 0 OR node > 1023 THEN 'invalid_node' WHEN ts_ms < 1704067200000 THEN 'before_epoch'
                          ELSE 'ok' END AS status FROM n),
    b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts_ms, event_id) - 1 AS rn FROM st WHERE status = 'ok'),
    s AS (SELECT *, rn + max(ts_ms * 4096 - rn) OVER (PARTITION BY node ORDER BY ts_ms, event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS slot FROM b)
    SELECT st.event_id, st.status, ((slot // 4096 - 1704067200000) << 22) | (s.node << 12) | (slot % 4096) AS id
    FROM st LEFT JOIN s USING (event_id)""", "requests"))
def q_mint_status(spark, sf):
    r = V.requests(spark, sf).select("event_id", (F.col("client") * NODE_STEP - 4).alias("node"),
                                     (F.col("ts_ms") - F.when(F.col("client") % 7 == 0, EARLY_MS).otherwise(0)).alias("ts_ms"))
    return D.mint_ids(r, "node", "ts_ms", "event_id").select("event_id", "status", "id")


@query("id_audit", with_views(_MINT_SQL + """,
    a AS (SELECT *, max(ts_ms) OVER (PARTITION BY node ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pts,
                    max(id) OVER (PARTITION BY node ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pid
          FROM i),
    n AS (SELECT node, count(*) AS ids, count(*) - count(DISTINCT id) AS duplicates,
                 count(*) FILTER (WHERE id <= pid) AS non_increasing, count(*) FILTER (WHERE ts_ms < pts) AS rewinds,
                 coalesce(max(pts - ts_ms) FILTER (WHERE ts_ms < pts), 0) AS max_rewind_ms FROM a GROUP BY node),
    ms AS (SELECT node, max(c) AS busiest_ms_ids, count(*) FILTER (WHERE c >= 4096) AS saturated_ms
           FROM (SELECT node, (id >> 22) + 1704067200000 AS mms, count(*) AS c FROM i GROUP BY 1, 2) GROUP BY node)
    SELECT * FROM n JOIN ms USING (node)""", "requests"))
def q_id_audit(spark, sf):
    return D.id_audit(_minted(spark, sf), "node", "id", "ts_ms", "event_id")


@query("mint_rate", with_views(_MINT_SQL + f"""
    SELECT node, mint_ms // {HOUR_MS} AS hour, count(*) AS minted, max(mint_ms - ts_ms) AS max_drift_ms
    FROM i GROUP BY 1, 2""", "requests"))
def q_mint_rate(spark, sf):
    minted = _minted(spark, sf).select("code", F.col("ts_ms").alias("created_at"))
    return D.mint_rate(minted, "created_at", HOUR_MS)


def _n_links(spark, sf) -> int:
    # One scalar: the size of the link table, which sets the Zipf support.
    return V.table(spark, sf, "orders").count()


_CDF_SQL = f"""
    WITH n AS (SELECT count(*) AS n FROM orders),
    r AS (SELECT range + 1 AS rank, 1.0 / pow(CAST(range + 1 AS DOUBLE), {ZIPF_S}) AS w FROM range((SELECT n FROM n))),
    c AS (SELECT rank, sum(w) OVER (ORDER BY rank) / sum(w) OVER () AS cdf FROM r)"""


@query("zipf_cdf", _CDF_SQL + " SELECT rank, round(cdf, 9) AS cdf FROM c")
def q_zipf_cdf(spark, sf):
    return W.zipf_cdf(spark, _n_links(spark, sf), ZIPF_S).select("rank", F.round("cdf", 9).alias("cdf"))


@query("zipf_requests", with_views(_CDF_SQL + f""",
    d AS (SELECT event_id, CAST(((event_id % 2147483648) * 2654435761 + {SEED}) % 4294967296 AS DOUBLE)
                           / 4294967296.0 AS u FROM requests)
    SELECT d.event_id, min(c.rank) AS rank, {sql_base62(f'min(c.rank) * {V.CODE_MULTIPLIER}')} AS code
    FROM d JOIN c ON c.cdf >= d.u GROUP BY d.event_id""", "requests"))
def q_zipf_requests(spark, sf):
    draws = V.requests(spark, sf).select("event_id", W.uniform("event_id", SEED).alias("u"))
    cdf = W.zipf_cdf(spark, _n_links(spark, sf), ZIPF_S)
    from linklens.functions.codecs import base62_encode
    out = W.zipf_sample(draws, cdf)
    # rank r is the link with id r - 1, whose code is base62((id + 1) * multiplier).
    return out.select("event_id", "rank", base62_encode(F.col("rank") * F.lit(V.CODE_MULTIPLIER)).alias("code"))


@query("ttl_jitter", with_views(f"""
    WITH j AS (SELECT greatest(1, CAST(floor({BASE_TTL_S}.0 - {BASE_TTL_S}.0 * 0.1
                 + (CAST(((id % 2147483648) * 2654435761 + {SEED}) % 4294967296 AS DOUBLE) / 4294967296.0)
                 * ({BASE_TTL_S}.0 * 0.1 * 2.0) + 0.5) AS BIGINT)) AS ttl_s FROM links)
    SELECT 'after' AS kind, ttl_s, count(*) AS n FROM j GROUP BY ttl_s
    UNION ALL SELECT 'before', CAST({BASE_TTL_S} AS BIGINT), count(*) FROM links""", "links"))
def q_ttl_jitter(spark, sf):
    links = V.links(spark, sf).withColumn("base", F.lit(BASE_TTL_S))
    j = W.ttl_jitter(links, "base", "id", SEED)
    after = j.groupBy(F.lit("after").alias("kind"), F.col("jittered").alias("ttl_s")).agg(F.count(F.lit(1)).alias("n"))
    before = links.groupBy(F.lit("before").alias("kind"), F.lit(BASE_TTL_S).cast("long").alias("ttl_s")).agg(
        F.count(F.lit(1)).alias("n"))
    return after.unionByName(before)

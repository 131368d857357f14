"""Sequential operator queries: limiters, TTL reuse, cache tiers, in-flight, outages."""

from __future__ import annotations

from pyspark.sql import functions as F

from linklens.operators import resolve as R
from linklens.operators import sequential as S
from linklens.plans import views as V
from linklens.plans.catalog import query
from linklens.plans.sql_seq import bucket_sql, inflight_sql, sliding_sql, ttl_sql
from linklens.plans.views import with_views

# --- fixed test-size parameters ---
SLIDE_LIMIT = 3
SLIDE_WINDOW_MS = 86_400_000
READ_LIMIT = 5
BUCKET_CAPACITY = 2.0
BUCKET_REFILL = 1 / 43200  # tokens per second
TTL_MS = 21_600_000  # 6 h
L1_TTL_MS = 21_600_000
L2_TTL_MS = 86_400_000
NEGATIVE_TTL_MS = 21_600_000
FAILURE_THRESHOLD = 3
# -------------------------------------------------------------------------------------

REFILL_SQL = f"CAST('{BUCKET_REFILL!r}' AS DOUBLE)"


def _req(spark, sf):
    return V.requests(spark, sf)


# ---- sliding window ----

@query("sliding_window_limit", with_views(sliding_sql(f"""
    SELECT client AS key, ts_ms AS ts, tie, CAST({SLIDE_LIMIT} AS BIGINT) AS lim,
           CAST({SLIDE_WINDOW_MS} AS BIGINT) AS win, event_id AS id FROM requests""",
    "id AS event_id"), "requests"))
def q_sliding(spark, sf):
    r = _req(spark, sf).select("event_id", "client", "ts_ms", "tie")
    out = S.sliding_window_limit(r, "client", "ts_ms", "tie", SLIDE_LIMIT, SLIDE_WINDOW_MS)
    return out.select("event_id", "allowed", "remaining", "reset_at", "retry_after_ms")


@query("token_bucket_limit", with_views(bucket_sql(f"""
    SELECT client AS key, ts_ms AS ts, tie, CAST({BUCKET_CAPACITY} AS DOUBLE) AS cap, {REFILL_SQL} AS ref,
           CAST(1.0 AS DOUBLE) AS cost, event_id AS id FROM requests""", "id AS event_id"), "requests"))
def q_bucket(spark, sf):
    r = _req(spark, sf).select("event_id", "client", "ts_ms", "tie")
    out = S.token_bucket_limit(r, "client", "ts_ms", "tie", BUCKET_CAPACITY, BUCKET_REFILL)
    return out.select("event_id", "allowed", "remaining", "reset_at", "retry_after_ms")


# ---- tiered ----

def tiered_limit(req):
    """Route each request to its tier's policy; key = tier:client so tiers never share budget."""
    keyed = req.withColumn("key", F.concat_ws(":", F.col("tier"), F.col("client").cast("string")))
    cols = keyed.columns
    windowed = keyed.where(F.col("tier").isin("write", "read"))
    lim = F.when(F.col("tier") == "write", SLIDE_LIMIT).otherwise(READ_LIMIT)
    windowed = windowed.withColumn("_plim", lim).withColumn("_pwin", F.lit(SLIDE_WINDOW_MS))
    slid = S.sliding_window_limit(windowed, "key", "ts_ms", "tie", "_plim", "_pwin").drop("_plim", "_pwin")
    bucketed = S.token_bucket_limit(keyed.where(F.col("tier") == "redirect"), "key", "ts_ms", "tie",
                                    BUCKET_CAPACITY, BUCKET_REFILL)
    exempt = keyed.where(~F.col("tier").isin("write", "read", "redirect"))
    for f in S.LIMIT_FIELDS:
        exempt = exempt.withColumn(f.name, F.lit(None).cast(f.dataType))
    names = cols + [f.name for f in S.LIMIT_FIELDS]
    return slid.select(*names).unionByName(bucketed.select(*names)).unionByName(exempt.select(*names))


_TIER_SRC = """SELECT tier || ':' || CAST(client AS VARCHAR) AS key, ts_ms AS ts, tie, event_id AS id"""
_TIERED_SQL = f"""
    SELECT * FROM ({sliding_sql(_TIER_SRC + f''', CAST(CASE WHEN tier = 'write' THEN {SLIDE_LIMIT}
           ELSE {READ_LIMIT} END AS BIGINT) AS lim, CAST({SLIDE_WINDOW_MS} AS BIGINT) AS win
           FROM requests WHERE tier IN ('write', 'read')''', "id AS event_id")})
    UNION ALL
    SELECT * FROM ({bucket_sql(_TIER_SRC + f''', CAST({BUCKET_CAPACITY} AS DOUBLE) AS cap, {REFILL_SQL} AS ref,
           CAST(1.0 AS DOUBLE) AS cost FROM requests WHERE tier = 'redirect' ''', "id AS event_id")})
    UNION ALL
    SELECT event_id, NULL::BOOLEAN, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM requests
    WHERE tier NOT IN ('write', 'read', 'redirect')"""


@query("tiered_limit", with_views(f"""
    SELECT t.event_id, r.tier, t.allowed, t.remaining, t.reset_at, t.retry_after_ms
    FROM ({_TIERED_SQL}) t JOIN requests r USING (event_id)""", "requests"))
def q_tiered(spark, sf):
    out = tiered_limit(_req(spark, sf).select("event_id", "client", "tier", "ts_ms", "tie"))
    return out.select("event_id", "tier", "allowed", "remaining", "reset_at", "retry_after_ms")


def limit_headers(decided):
    """X-RateLimit-Limit/Remaining/Reset on every limited response; Retry-After only on rejection."""
    return decided.select(
        "event_id",
        F.col("limit").alias("x_ratelimit_limit"),
        F.col("remaining").alias("x_ratelimit_remaining"),
        F.ceil(F.col("reset_at") / 1000.0).cast("long").alias("x_ratelimit_reset"),
        F.when(~F.col("allowed"), F.greatest(F.lit(1), F.ceil(F.col("retry_after_ms") / 1000.0)))
         .cast("long").alias("retry_after"))


@query("limit_headers", with_views(f"""
    SELECT t.event_id,
           CAST(CASE r.tier WHEN 'write' THEN {SLIDE_LIMIT} WHEN 'read' THEN {READ_LIMIT}
                WHEN 'redirect' THEN {int(BUCKET_CAPACITY)} END AS BIGINT) AS x_ratelimit_limit,
           t.remaining AS x_ratelimit_remaining,
           CAST(ceil(t.reset_at / 1000.0) AS BIGINT) AS x_ratelimit_reset,
           CAST(CASE WHEN NOT t.allowed THEN greatest(1, ceil(t.retry_after_ms / 1000.0)) END AS BIGINT)
             AS retry_after
    FROM ({_TIERED_SQL}) t JOIN requests r USING (event_id)
    WHERE r.tier IN ('write', 'read', 'redirect')""", "requests"))
def q_limit_headers(spark, sf):
    out = tiered_limit(_req(spark, sf).select("event_id", "client", "tier", "ts_ms", "tie"))
    return limit_headers(out.where(F.col("allowed").isNotNull()))


@query("limit_audit", with_views(f"""
    SELECT r.tier, r.client, count(*) FILTER (WHERE t.allowed) AS admitted,
           count(*) FILTER (WHERE NOT t.allowed) AS rejected
    FROM ({_TIERED_SQL}) t JOIN requests r USING (event_id)
    WHERE r.tier IN ('write', 'read', 'redirect') GROUP BY r.tier, r.client""", "requests"))
def q_limit_audit(spark, sf):
    out = tiered_limit(_req(spark, sf).select("event_id", "client", "tier", "ts_ms", "tie"))
    return (out.where(F.col("allowed").isNotNull()).groupBy("tier", "client")
            .agg(F.count_if(F.col("allowed")).alias("admitted"), F.count_if(~F.col("allowed")).alias("rejected")))


_AUDITED_SQL = f"""
    WITH d AS (SELECT r.tier, r.client, r.ts_ms, r.tie, t.allowed, CASE r.tier WHEN 'write' THEN {SLIDE_LIMIT} ELSE {READ_LIMIT} END AS lim
               FROM ({_TIERED_SQL}) t JOIN requests r USING (event_id) WHERE r.tier IN ('write', 'read')),
    w AS (SELECT d.tier, d.client, d.ts_ms, d.tie, d.allowed, d.lim, count(a.tie) AS inside
          FROM d LEFT JOIN d a ON a.tier = d.tier AND a.client = d.client AND a.allowed AND a.ts_ms > d.ts_ms - {SLIDE_WINDOW_MS}
                               AND (a.ts_ms < d.ts_ms OR (a.ts_ms = d.ts_ms AND a.tie < d.tie))
          GROUP BY ALL)"""


@query("limit_window_audit", with_views(_AUDITED_SQL + f"""
    SELECT tier, client, ts_ms // {SLIDE_WINDOW_MS} AS window_no, count(*) FILTER (WHERE allowed) AS admitted,
           count(*) FILTER (WHERE NOT allowed) AS rejected, max(inside + CAST(allowed AS INTEGER)) AS peak,
           count(*) FILTER (WHERE allowed AND inside >= lim) AS over_limit,
           count(*) FILTER (WHERE NOT allowed AND inside <> lim) AS wrong_rejections
    FROM w GROUP BY ALL""", "requests"))
def q_limit_window_audit(spark, sf):
    """Decisions held against the rule alone: no window has more than the limit, every rejection finds exactly the limit."""
    out = tiered_limit(_req(spark, sf).select("event_id", "client", "tier", "ts_ms", "tie"))
    seen = S.audit_windows(out.where(F.col("tier").isin("write", "read")), ["tier", "client"], "ts_ms", "tie", SLIDE_WINDOW_MS)
    return seen.groupBy("tier", "client", F.call_function("div", F.col("ts_ms"), F.lit(SLIDE_WINDOW_MS)).alias("window_no")).agg(
        F.count_if("allowed").alias("admitted"), F.count_if(~F.col("allowed")).alias("rejected"),
        F.max(F.col("inside") + F.col("allowed").cast("long")).alias("peak"),
        F.count_if(F.col("allowed") & (F.col("inside") >= F.col("limit"))).alias("over_limit"),
        F.count_if(~F.col("allowed") & (F.col("inside") != F.col("limit"))).alias("wrong_rejections"))


@query("limit_rejections", with_views(f"""
    SELECT r.tier, count(*) AS decided, count(*) FILTER (WHERE NOT t.allowed) AS rejected,
           count(DISTINCT r.client) FILTER (WHERE NOT t.allowed) AS clients
    FROM ({_TIERED_SQL}) t JOIN requests r USING (event_id) WHERE t.allowed IS NOT NULL GROUP BY r.tier""", "requests"))
def q_limit_rejections(spark, sf):
    """Rejections by tier."""
    out = tiered_limit(_req(spark, sf).select("event_id", "client", "tier", "ts_ms", "tie")).where(F.col("allowed").isNotNull())
    per = out.groupBy("tier", "client").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("allowed")).alias("r"))
    return per.groupBy("tier").agg(F.sum("n").alias("decided"), F.sum("r").alias("rejected"), F.count_if(F.col("r") > 0).alias("clients"))


@query("degraded_limit", with_views(f"""
    WITH shared AS ({sliding_sql(f'''SELECT CAST(client AS VARCHAR) AS key, ts_ms AS ts, tie,
             CAST({SLIDE_LIMIT} AS BIGINT) AS lim, CAST({SLIDE_WINDOW_MS} AS BIGINT) AS win, event_id AS id
             FROM requests WHERE tier = 'write' ''', "id AS event_id")}),
    local AS ({sliding_sql(f'''SELECT CAST(client AS VARCHAR) || ':' || CAST(instance AS VARCHAR) AS key,
             ts_ms AS ts, tie, CAST({SLIDE_LIMIT} AS BIGINT) AS lim, CAST({SLIDE_WINDOW_MS} AS BIGINT) AS win,
             event_id AS id FROM requests WHERE tier = 'write' ''', "id AS event_id")})
    SELECT r.client, count(*) FILTER (WHERE s.allowed) AS shared_admitted,
           count(*) FILTER (WHERE l.allowed) AS local_admitted,
           round(CAST(count(*) FILTER (WHERE l.allowed) AS DOUBLE)
                 / count(*) FILTER (WHERE s.allowed), 6) AS over_admission
    FROM requests r JOIN shared s USING (event_id) JOIN local l USING (event_id)
    GROUP BY r.client""", "requests"))
def q_degraded(spark, sf):
    """Shared budget vs per-replica budgets on the same write log."""
    w = _req(spark, sf).where(F.col("tier") == "write").select("event_id", "client", "instance", "ts_ms", "tie")
    shared = S.sliding_window_limit(w.withColumn("key", F.col("client").cast("string")),
                                    "key", "ts_ms", "tie", SLIDE_LIMIT, SLIDE_WINDOW_MS)
    local = S.sliding_window_limit(
        w.withColumn("key", F.concat_ws(":", F.col("client").cast("string"), F.col("instance").cast("string"))),
        "key", "ts_ms", "tie", SLIDE_LIMIT, SLIDE_WINDOW_MS)
    j = (shared.select("event_id", "client", F.col("allowed").alias("s_ok"))
         .join(local.select("event_id", F.col("allowed").alias("l_ok")), "event_id"))
    agg = j.groupBy("client").agg(F.count_if("s_ok").alias("shared_admitted"),
                                  F.count_if("l_ok").alias("local_admitted"))
    return agg.withColumn("over_admission",
                          F.round(F.col("local_admitted").cast("double") / F.col("shared_admitted"), 6))


# ---- TTL reuse and cache tiers ----

@query("ttl_first_touch", with_views(ttl_sql(f"""
    SELECT code AS key, ts_ms AS ts, tie, CAST({TTL_MS} AS BIGINT) AS ttl, 'read' AS kind,
           NULL::BIGINT AS tcap, event_id AS id FROM requests WHERE tier = 'redirect'""",
    "id AS event_id"), "requests"))
def q_ttl(spark, sf):
    r = _req(spark, sf).where(F.col("tier") == "redirect").select("event_id", "code", "ts_ms", "tie")
    return S.ttl_first_touch(r, "code", "ts_ms", "tie", TTL_MS).select("event_id", "is_fill", "leader_ts")


def _negative_events(spark, sf):
    """Probes of missing codes (reads) interleaved with creates of the same code (clears)."""
    req = _req(spark, sf)
    links = V.request_links(spark, sf)
    probes = (req.where(F.col("tier") == "redirect").join(links.select("code"), "code", "left_anti")
              .select("event_id", "code", "ts_ms", "tie", F.lit("read").alias("kind")))
    creates = req.where(F.col("event_type") == "signup").select("event_id", "code", "ts_ms", "tie",
                                                                  F.lit("clear").alias("kind"))
    return probes.unionByName(creates)


@query("negative_touch", with_views(ttl_sql(f"""
    SELECT code AS key, ts_ms AS ts, tie, CAST({NEGATIVE_TTL_MS} AS BIGINT) AS ttl, 'read' AS kind,
           NULL::BIGINT AS tcap, event_id AS id
    FROM requests r WHERE tier = 'redirect' AND NOT EXISTS (SELECT 1 FROM request_links l WHERE l.code = r.code)
    UNION ALL
    SELECT code, ts_ms, tie, CAST({NEGATIVE_TTL_MS} AS BIGINT), 'clear', NULL::BIGINT, event_id
    FROM requests WHERE event_type = 'signup'""", "id AS event_id"), "requests", "request_links"))
def q_negative(spark, sf):
    ev = _negative_events(spark, sf)
    out = S.ttl_first_touch(ev, "code", "ts_ms", "tie", NEGATIVE_TTL_MS, kind="kind")
    return out.where(F.col("kind") == "read").select("event_id", "is_fill", "leader_ts")


def attributed_reads(spark, sf):
    """Each resolved-ok read with its code, instance and time -> l1 / l2 / l3 via two chained TTL passes.

    Pass 1 (L1) is keyed by (instance, code); creates write through on the
    creating instance, deletes clear that instance only. Pass 2 (L2) is keyed
    by code and sees L1 misses; creates fill it, deletes clear it. A fill's TTL
    is capped by the link's remaining life. A read without a time meets no entry, so it is l3; writes without time or
    code change no tier.
    """
    req, kept = _req(spark, sf), ["event_id", "code", "instance", "ts_ms"]
    untimed = R.resolve_requests(req.where((F.col("tier") == "redirect") & F.col("ts_ms").isNull()), V.request_links(spark, sf))
    untimed = untimed.where(F.col("outcome") == "ok").select(*kept, F.lit("l3").alias("tier"))
    req = req.where(F.col("ts_ms").isNotNull())
    res = R.resolve_requests(req.where(F.col("tier") == "redirect"), V.request_links(spark, sf)).where(F.col("outcome") == "ok")
    exp = V.request_links(spark, sf).select("code", "expires_at")
    reads = (res.select("event_id", "code", "instance", "ts_ms", "tie").join(exp, "code", "left")
             .select("event_id", "code", "instance", "ts_ms", "tie", F.lit("read").alias("kind"),
                     (F.col("expires_at") - F.col("ts_ms")).alias("tcap")))
    writes = req.where(F.col("event_type").isin("signup", "purchase") & F.col("code").isNotNull()).select(
        "event_id", "code", "instance", "ts_ms", "tie",
        F.when(F.col("event_type") == "signup", "fill").otherwise("clear").alias("kind"),
        F.lit(None).cast("long").alias("tcap"))
    ev = reads.unionByName(writes).withColumn(
        "l1key", F.concat_ws(":", F.col("instance").cast("string"), F.col("code")))
    p1 = S.ttl_first_touch(ev, "l1key", "ts_ms", "tie", L1_TTL_MS, kind="kind", ttl_cap="tcap")
    l1_hits = p1.where((F.col("kind") == "read") & ~F.col("is_fill")).select(*kept, F.lit("l1").alias("tier"))
    misses = p1.where((F.col("kind") == "read") & F.col("is_fill")).select(ev.columns)
    p2 = S.ttl_first_touch(misses.unionByName(writes.withColumn("l1key", F.lit(None).cast("string"))),
                           "code", "ts_ms", "tie", L2_TTL_MS, kind="kind", ttl_cap="tcap")
    rest = p2.where(F.col("kind") == "read").select(
        *kept, F.when(F.col("is_fill"), "l3").otherwise("l2").alias("tier"))
    return l1_hits.unionByName(rest).unionByName(untimed)


def tier_attribution(spark, sf):
    """Each resolved-ok read -> l1 / l2 / l3."""
    return attributed_reads(spark, sf).select("event_id", "tier")


def _tier_sql() -> str:
    ok_reads = """
        SELECT r.event_id, r.code, r.instance, r.ts_ms, r.tie, 'read' AS kind, l.expires_at - r.ts_ms AS tcap
        FROM requests r JOIN request_links l ON r.code = l.code
        WHERE r.tier = 'redirect' AND NOT (l.expires_at IS NOT NULL AND l.expires_at <= r.ts_ms)"""
    writes = """
        SELECT event_id, code, instance, ts_ms, tie,
               CASE WHEN event_type = 'signup' THEN 'fill' ELSE 'clear' END AS kind, NULL::BIGINT AS tcap
        FROM requests WHERE event_type IN ('signup', 'purchase')"""
    p1 = ttl_sql(f"""SELECT CAST(instance AS VARCHAR) || ':' || code AS key, ts_ms AS ts, tie,
                            CAST({L1_TTL_MS} AS BIGINT) AS ttl, kind, tcap, event_id AS id
                     FROM ({ok_reads} UNION ALL {writes})""", "id AS event_id")
    p2 = ttl_sql(f"""SELECT code AS key, ts_ms AS ts, tie, CAST({L2_TTL_MS} AS BIGINT) AS ttl, kind, tcap,
                            event_id AS id
                     FROM (SELECT o.* FROM ({ok_reads}) o JOIN ({p1}) a ON a.event_id = o.event_id
                           WHERE a.is_fill
                           UNION ALL {writes})""", "id AS event_id")
    return f"""
        SELECT event_id, 'l1' AS tier FROM ({p1}) WHERE NOT is_fill
        UNION ALL
        SELECT event_id, CASE WHEN is_fill THEN 'l3' ELSE 'l2' END AS tier FROM ({p2})"""


@query("tier_attribution", with_views(_tier_sql(), "requests", "request_links"))
def q_tier_attribution(spark, sf):
    return tier_attribution(spark, sf)


# ---- in-flight collapse and outages ----

def _work(spark, sf):
    """Work intervals: start = ts, end = start + value seconds, keyed by code."""
    r = _req(spark, sf)
    return r.select("event_id", "code", F.col("ts_ms").alias("start_ms"), "tie",
                    (F.col("ts_ms") + F.floor(F.col("latency_s") * 1000.0 * 1000.0).cast("long")).alias("end_ms"))


_WORK_SRC = """SELECT code AS key, ts_ms AS ts, tie, ts_ms + CAST(floor(latency_s * 1000.0 * 1000.0) AS BIGINT) AS e,
                      event_id AS id FROM requests"""


@query("inflight_collapse", with_views(inflight_sql(_WORK_SRC, "id AS event_id"), "requests"))
def q_inflight(spark, sf):
    out = S.inflight_collapse(_work(spark, sf), "code", "start_ms", "end_ms", "tie")
    return out.select("event_id", "executed", "leader_start")


@query("inflight_summary", with_views(f"""
    SELECT r.code, count(*) FILTER (WHERE executed) AS executed, count(*) FILTER (WHERE NOT executed) AS joined
    FROM ({inflight_sql(_WORK_SRC, "id AS event_id")}) x JOIN requests r USING (event_id)
    GROUP BY r.code""", "requests"))
def q_inflight_summary(spark, sf):
    out = S.inflight_collapse(_work(spark, sf), "code", "start_ms", "end_ms", "tie")
    return out.groupBy("code").agg(F.count_if("executed").alias("executed"),
                                   F.count_if(~F.col("executed")).alias("joined"))


@query("failure_episodes", with_views(f"""
    WITH o AS (
      SELECT dependency, ts_ms, tie, ok,
             sum(CAST(ok AS INTEGER)) OVER (PARTITION BY dependency ORDER BY ts_ms, tie) AS island,
             sum(1 - CAST(ok AS INTEGER)) OVER (PARTITION BY dependency ORDER BY ts_ms, tie) AS fails
      FROM requests),
    runs AS (
      SELECT dependency, island, count(*) AS failures, min(fails) AS first_rank,
             min(ts_ms) AS first_failure_ms, max(ts_ms) AS last_failure_ms
      FROM o WHERE NOT ok GROUP BY dependency, island HAVING count(*) >= {FAILURE_THRESHOLD}),
    opening AS (
      SELECT o.dependency, o.island, o.ts_ms AS opened_ms FROM o JOIN runs r USING (dependency, island)
      WHERE NOT o.ok AND o.fails - r.first_rank + 1 = {FAILURE_THRESHOLD}),
    closing AS (SELECT dependency, island - 1 AS island, min(ts_ms) AS closed_ms FROM o WHERE ok
                GROUP BY dependency, island)
    SELECT r.dependency, r.island, r.failures, r.first_failure_ms, p.opened_ms, c.closed_ms,
           c.closed_ms - p.opened_ms AS duration_ms
    FROM runs r JOIN opening p USING (dependency, island) LEFT JOIN closing c USING (dependency, island)""",
    "requests"))
def q_failure_episodes(spark, sf):
    r = _req(spark, sf).select("dependency", "ts_ms", "tie", "ok")
    return S.failure_episodes(r, "dependency", "ts_ms", "tie", "ok", FAILURE_THRESHOLD)

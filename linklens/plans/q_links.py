"""Link-table, shard and pagination queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linklens.operators import links as L
from linklens.operators import paging as P
from linklens.operators import resolve as R
from linklens.plans import views as V
from linklens.plans.catalog import query
from linklens.plans.views import sql_fnv, with_views
from linklens.session import scratch_path
from linklens.sources import links_io as IO
from linklens.sources.versions import VersionedLinks, reap

# --- fixed query parameters ---
SHARDS = 4
SERVERS = 3
RESHARD_TO = 6
NOW_LIVE_MS = 896659200000  # 1998-06-01T00:00:00Z, inside the orders date range
NOW_DASHBOARD_MS = 1009843200000  # 2002-01-01T00:00:00Z
PAGE_LIMIT = 20
CURSOR = "ODgzNjEyODAwMDAwOjEwMA"  # base64url("883612800000:100")
BASE_URL = "https://sho.rt/"
NEW_ID_OFFSET = 1_000_000_000_000
# ------------------------------

SHARD_SQL = f"CAST(({sql_fnv('code')}) % {SHARDS} AS INTEGER)"
LINK_COLS = "id, code, url, created_at, expires_at, clicks, last_accessed_at"


def _b64url_sql(x: str) -> str:
    return f"rtrim(replace(replace(to_base64(encode({x})), '+', '-'), '/', '_'), '=')"


CURSOR_SQL = _b64url_sql("CAST(created_at AS VARCHAR) || ':' || CAST(id AS VARCHAR)")


def _staged_links(spark, sf):
    return IO.read_links(spark, IO.stage_sharded(V.links(spark, sf), SHARDS))


@query("links_table", with_views(f"SELECT {LINK_COLS}, {SHARD_SQL} AS shard FROM links", "links"))
def q_links_table(spark, sf):
    return _staged_links(spark, sf)


@query("write_sharded", with_views(f"SELECT {SHARD_SQL} AS shard, count(*) AS n FROM links GROUP BY 1", "links"))
def q_write_sharded(spark, sf):
    df = _staged_links(spark, sf)
    return df.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("union_shards", with_views(f"SELECT {LINK_COLS}, {SHARD_SQL} AS shard FROM links", "links"))
def q_union_shards(spark, sf):
    path = IO.stage_sharded(V.links(spark, sf), SHARDS)
    return IO.union_shards(spark, path, SHARDS)


_DIST_SQL = f"""
    SELECT s.shard, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
           CAST(sum(coalesce(c.n, 0)) OVER () AS BIGINT) AS total,
           CASE WHEN sum(coalesce(c.n, 0)) OVER () = 0 THEN 0.0
                ELSE floor(CAST(coalesce(c.n, 0) AS DOUBLE) / sum(coalesce(c.n, 0)) OVER () * 1000.0 + 0.5) / 10.0
           END AS share
    FROM (SELECT CAST(range AS INTEGER) AS shard FROM range({SHARDS})) s
    LEFT JOIN (SELECT {SHARD_SQL} AS shard, count(*) AS n FROM links GROUP BY 1) c ON s.shard = c.shard"""


@query("shard_distribution", with_views(_DIST_SQL, "links"))
def q_shard_distribution(spark, sf):
    return L.shard_distribution(V.links(spark, sf), SHARDS)


@query("shard_skew", with_views(f"""
    SELECT shard, n, total,
           CASE WHEN total / {float(SHARDS)} = 0 THEN 0.0
                ELSE round((n - total / {float(SHARDS)}) / (total / {float(SHARDS)}) * 100.0, 3) END AS deviation_pct,
           abs(CASE WHEN total / {float(SHARDS)} = 0 THEN 0.0
                ELSE round((n - total / {float(SHARDS)}) / (total / {float(SHARDS)}) * 100.0, 3) END) <= 5.0
             AS within_tolerance,
           n > 0 AS used
    FROM ({_DIST_SQL})""", "links"))
def q_shard_skew(spark, sf):
    return L.shard_skew(L.shard_distribution(V.links(spark, sf), SHARDS), SHARDS)


@query("server_load", with_views(f"""
    SELECT CAST(({SHARD_SQL}) % {SERVERS} AS INTEGER) AS server, count(*) AS n FROM links GROUP BY 1""", "links"))
def q_server_load(spark, sf):
    return L.server_load(V.links(spark, sf), SHARDS, SERVERS)


@query("reshard_plan", with_views(f"""
    SELECT from_shard, to_shard, n, from_shard <> to_shard AS moves,
           floor(CAST(n AS DOUBLE) / sum(n) OVER () * 1000.0 + 0.5) / 10.0 AS share
    FROM (SELECT CAST(h % {SHARDS} AS INTEGER) AS from_shard, CAST(h % {RESHARD_TO} AS INTEGER) AS to_shard,
                 count(*) AS n
          FROM (SELECT {sql_fnv('code')} AS h FROM links) GROUP BY 1, 2)""", "links"))
def q_reshard_plan(spark, sf):
    return L.reshard_plan(V.links(spark, sf), SHARDS, RESHARD_TO)


_DELTAS_SQL = "SELECT code, count(*) AS count, max(ts_ms) AS last_accessed_at FROM clicks GROUP BY code"


@query("coalesce_clicks", with_views(_DELTAS_SQL, "clicks"))
def q_coalesce_clicks(spark, sf):
    return L.coalesce_clicks(V.clicks(spark, sf))


_APPLIED_SQL = f"""
    SELECT l.id, l.code, l.url, l.created_at, l.expires_at,
           CAST(l.clicks + coalesce(d.count, 0) AS BIGINT) AS clicks,
           CAST(CASE WHEN d.count IS NULL THEN l.last_accessed_at
                     ELSE greatest(coalesce(l.last_accessed_at, 0), d.last_accessed_at) END AS BIGINT)
             AS last_accessed_at
    FROM request_links l LEFT JOIN ({_DELTAS_SQL}) d ON l.code = d.code"""


@query("apply_clicks", with_views(_APPLIED_SQL, "request_links", "clicks"))
def q_apply_clicks(spark, sf):
    deltas = L.coalesce_clicks(V.clicks(spark, sf))
    return L.apply_clicks(V.request_links(spark, sf), deltas)


@query("link_totals", with_views(f"""
    SELECT count(*) AS links, CAST(coalesce(sum(clicks), 0) AS BIGINT) AS total_clicks,
           count(DISTINCT CAST(({sql_fnv('code')}) % {SHARDS} AS INTEGER)) AS shards_in_use
    FROM ({_APPLIED_SQL})""", "request_links", "clicks"))
def q_link_totals(spark, sf):
    applied = L.apply_clicks(V.request_links(spark, sf), L.coalesce_clicks(V.clicks(spark, sf)))
    return L.link_totals(applied, SHARDS)


def _new_link_batch(spark, sf):
    r = V.requests(spark, sf).where(F.col("event_type") == "signup")
    return r.select((F.col("event_id") + F.lit(NEW_ID_OFFSET)).alias("id"), "code",
                    F.concat(F.lit("https://example.com/new/"), F.col("event_id").cast("string")).alias("url"),
                    F.col("ts_ms").alias("created_at"), F.lit(None).cast("long").alias("expires_at"))


@query("insert_unique", with_views(f"""
    SELECT b.id, b.code,
           CASE WHEN b.rn = 1 AND s.code IS NULL THEN 'inserted' ELSE 'ALIAS_TAKEN' END AS status
    FROM (SELECT event_id + {NEW_ID_OFFSET} AS id, code, ts_ms AS created_at,
                 row_number() OVER (PARTITION BY code ORDER BY ts_ms, event_id + {NEW_ID_OFFSET}) AS rn
          FROM requests WHERE event_type = 'signup') b
    LEFT JOIN (SELECT DISTINCT code FROM request_links) s ON b.code = s.code""", "requests", "request_links"))
def q_insert_unique(spark, sf):
    decided = L.insert_unique(V.request_links(spark, sf), _new_link_batch(spark, sf))
    return decided.select("id", "code", "status")


@query("delete_codes", with_views("""
    SELECT d.code, CASE WHEN l.code IS NOT NULL THEN 'deleted' ELSE 'NOT_FOUND' END AS result
    FROM (SELECT DISTINCT code FROM requests WHERE method = 'DELETE') d
    LEFT JOIN request_links l ON d.code = l.code""", "requests", "request_links"))
def q_delete_codes(spark, sf):
    codes = V.requests(spark, sf).where(F.col("method") == "DELETE").select("code")
    _, report = L.delete_codes(V.request_links(spark, sf), codes)
    return report


@query("live_links", with_views(f"""
    SELECT id, code, expires_at FROM links WHERE expires_at IS NULL OR expires_at > {NOW_LIVE_MS}""", "links"))
def q_live_links(spark, sf):
    return L.live_links(V.links(spark, sf), NOW_LIVE_MS).select("id", "code", "expires_at")


@query("reap_expired", with_views(f"""
    SELECT id, coalesce(expires_at <= {NOW_LIVE_MS}, false) AS reaped FROM links""", "links"))
def q_reap_expired(spark, sf):
    return L.reap_expired(V.links(spark, sf), NOW_LIVE_MS).select("id", "reaped")


def _links_table(spark, sf):
    links = V.links(spark, sf)
    table = VersionedLinks(spark, scratch_path(spark, f"reap-{uuid.uuid4().hex}"), SHARDS, links.schema)
    table.create(links)
    return table


@query("reap_rewrite", with_views(f"""
    SELECT {LINK_COLS}, {SHARD_SQL} AS shard FROM links WHERE expires_at IS NULL OR expires_at > {NOW_LIVE_MS}""", "links"))
def q_reap_rewrite(spark, sf):
    """The link table after its shards with expired links were rewritten."""
    table = _links_table(spark, sf)
    version, _ = reap(table, NOW_LIVE_MS)
    return table.read(version)


@query("reap_report", with_views(f"""
    SELECT shard, count(*) FILTER (WHERE x) AS expired, count(*) FILTER (WHERE NOT x) AS kept, bool_or(x) AS rewritten
    FROM (SELECT {SHARD_SQL} AS shard, coalesce(expires_at <= {NOW_LIVE_MS}, false) AS x FROM links) GROUP BY shard""", "links"))
def q_reap_report(spark, sf):
    return reap(_links_table(spark, sf), NOW_LIVE_MS)[1]


_LOOKUP_IDS = list(range(0, 40, 3))


def _lookup_literals():
    from linklens.functions.codecs import BASE62_ALPHABET

    def enc(n: int) -> str:
        out = ""
        while n:
            n, r = divmod(n, 62)
            out = BASE62_ALPHABET[r] + out
        return out or "0"

    return [enc((i + 1) * V.CODE_MULTIPLIER) for i in _LOOKUP_IDS] + ["zzzzzz", "missing1"]


@query("lookup_codes", with_views(f"""
    SELECT {LINK_COLS}, {SHARD_SQL} AS shard FROM links
    WHERE code IN ({", ".join(repr(c) for c in _lookup_literals())})""", "links"))
def q_lookup_codes(spark, sf):
    return R.lookup_codes(_staged_links(spark, sf), _lookup_literals(), SHARDS)


@query("present_links", with_views(f"""
    SELECT CAST(id AS VARCHAR) AS id, code, '{BASE_URL.rstrip('/')}/' || code AS short_url, url, clicks,
           strftime(make_timestamp(created_at * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at,
           strftime(make_timestamp(expires_at * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS expires_at,
           strftime(make_timestamp(last_accessed_at * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_accessed_at
    FROM ({_APPLIED_SQL})""", "request_links", "clicks"))
def q_present_links(spark, sf):
    applied = L.apply_clicks(V.request_links(spark, sf), L.coalesce_clicks(V.clicks(spark, sf)))
    return IO.present_links(applied, BASE_URL)


@query("distinct_codes", with_views("""
    SELECT r.code, count(DISTINCT r.instance) AS n_instances, count(DISTINCT l.url) AS n_targets
    FROM requests r LEFT JOIN links l ON r.code = l.code
    WHERE r.tier = 'redirect' GROUP BY r.code""", "requests", "links"))
def q_distinct_codes(spark, sf):
    reqs = V.requests(spark, sf).where(F.col("tier") == "redirect")
    j = reqs.join(V.links(spark, sf).select("code", "url"), "code", "left")
    return j.groupBy("code").agg(F.countDistinct("instance").alias("n_instances"),
                                 F.countDistinct("url").alias("n_targets"))


# ---- pagination ----

def _page_sql(where: str) -> str:
    return f"""
    SELECT id, code, created_at,
           CASE WHEN count(*) OVER () = {PAGE_LIMIT}
                THEN last_value({CURSOR_SQL}) OVER (ORDER BY created_at DESC, id DESC
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_cursor
    FROM (SELECT * FROM links {where} ORDER BY created_at DESC, id DESC LIMIT {PAGE_LIMIT})"""


@query("list_page", with_views(_page_sql(""), "links"))
def q_list_page(spark, sf):
    return P.list_page(V.links(spark, sf), PAGE_LIMIT).select("id", "code", "created_at", "next_cursor")


@query("list_page_cursor", with_views(_page_sql(
    "WHERE created_at < 883612800000 OR (created_at = 883612800000 AND id < 100)"), "links"))
def q_list_page_cursor(spark, sf):
    return P.list_page(V.links(spark, sf), PAGE_LIMIT, CURSOR).select("id", "code", "created_at", "next_cursor")


@query("shard_topk", with_views(f"""
    SELECT id, code, created_at FROM links ORDER BY created_at DESC, id DESC LIMIT {PAGE_LIMIT}""", "links"))
def q_shard_topk(spark, sf):
    return P.shard_topk(_staged_links(spark, sf), SHARDS, PAGE_LIMIT).select("id", "code", "created_at")


@query("page_numbers", with_views(f"""
    WITH ranked AS (
      SELECT id, code, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) - 1 AS pos,
             {CURSOR_SQL} AS cur
      FROM links)
    SELECT a.id, a.pos, a.pos // {PAGE_LIMIT} AS page, b.cur AS start_cursor
    FROM ranked a LEFT JOIN ranked b ON b.pos = (a.pos // {PAGE_LIMIT}) * {PAGE_LIMIT} - 1""", "links"))
def q_page_numbers(spark, sf):
    return P.page_numbers(V.links(spark, sf), PAGE_LIMIT).select("id", "pos", "page", "start_cursor")


@query("page_walk_check", with_views("""
    SELECT count(*) AS table_rows, count(*) AS paged_rows, CAST(0 AS BIGINT) AS missing,
           CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS duplicates FROM links""", "links"))
def q_page_walk_check(spark, sf):
    links = V.links(spark, sf)
    return P.page_walk_check(links, P.page_numbers(links, PAGE_LIMIT))


@query("recent_links", with_views(f"""
    WITH page AS (SELECT * FROM links ORDER BY created_at DESC, id DESC LIMIT {PAGE_LIMIT}),
    aged AS (SELECT *, greatest(0.0, ({NOW_DASHBOARD_MS} - created_at) / 1000.0) AS s FROM page)
    SELECT code, url, clicks, {SHARD_SQL} AS shard,
           CASE WHEN s < 60 THEN CAST(CAST(floor(s) AS BIGINT) AS VARCHAR) || 's ago'
                WHEN s < 3600 THEN CAST(CAST(floor(s / 60) AS BIGINT) AS VARCHAR) || 'm ago'
                WHEN s < 86400 THEN CAST(CAST(floor(s / 3600) AS BIGINT) AS VARCHAR) || 'h ago'
                ELSE CAST(CAST(floor(s / 86400) AS BIGINT) AS VARCHAR) || 'd ago' END AS age,
           created_at, id
    FROM aged""", "links"))
def q_recent_links(spark, sf):
    return P.recent_links(V.links(spark, sf), SHARDS, NOW_DASHBOARD_MS, PAGE_LIMIT)

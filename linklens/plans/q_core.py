"""Resolution, link-table and shard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linklens.operators import resolve as R
from linklens.plans import views as V
from linklens.plans.catalog import query
from linklens.plans.views import with_views


def _redirects(spark, sf):
    return V.requests(spark, sf).where(F.col("tier") == "redirect")


@query("resolve_requests", with_views("""
    SELECT r.event_id, r.code, r.instance,
           CASE WHEN l.code IS NULL THEN 'not_found'
                WHEN l.expires_at IS NOT NULL AND l.expires_at <= r.ts_ms THEN 'expired'
                ELSE 'ok' END AS outcome,
           CAST(CASE WHEN l.code IS NULL THEN 404
                WHEN l.expires_at IS NOT NULL AND l.expires_at <= r.ts_ms THEN 410
                ELSE 302 END AS INTEGER) AS http_status,
           CASE WHEN l.code IS NOT NULL AND NOT (l.expires_at IS NOT NULL AND l.expires_at <= r.ts_ms)
                THEN l.url END AS target
    FROM requests r LEFT JOIN request_links l ON r.code = l.code
    WHERE r.tier = 'redirect'""", "requests", "request_links"))
def q_resolve_requests(spark, sf):
    res = R.resolve_requests(_redirects(spark, sf), V.request_links(spark, sf))
    return res.select("event_id", "code", "instance", "outcome", "http_status", "target")


@query("redirect_outcomes", with_views("""
    SELECT outcome, instance, count(*) AS n FROM (
      SELECT r.instance,
             CASE WHEN l.code IS NULL THEN 'not_found'
                  WHEN l.expires_at IS NOT NULL AND l.expires_at <= r.ts_ms THEN 'expired'
                  ELSE 'ok' END AS outcome
      FROM requests r LEFT JOIN request_links l ON r.code = l.code
      WHERE r.tier = 'redirect') GROUP BY outcome, instance""", "requests", "request_links"))
def q_redirect_outcomes(spark, sf):
    res = R.resolve_requests(_redirects(spark, sf), V.request_links(spark, sf))
    return R.redirect_outcomes(res)


@query("screen_requests", with_views("""
    SELECT event_id, code FROM requests
    WHERE length(code) BETWEEN 1 AND 32 AND regexp_matches(code, '^[A-Za-z0-9_-]+$')
      AND lower(code) NOT IN ('api','health','healthz','ready','readyz','live','metrics','admin','static',
        'assets','public','favicon.ico','robots.txt','sitemap.xml','login','logout','signin','signup',
        'register','account','settings','dashboard','docs','doc','help','support','about','terms',
        'privacy','security','status','null','undefined','new','edit','delete')""", "requests"))
def q_screen_requests(spark, sf):
    return R.screen_requests(V.requests(spark, sf)).select("event_id", "code")


@query("missing_codes", with_views("""
    SELECT code, client, count(*) AS probes, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
    FROM requests r WHERE r.tier = 'redirect'
      AND NOT EXISTS (SELECT 1 FROM request_links l WHERE l.code = r.code)
    GROUP BY code, client""", "requests", "request_links"))
def q_missing_codes(spark, sf):
    return R.missing_codes(_redirects(spark, sf), V.request_links(spark, sf))


@query("click_enrich", with_views("""
    SELECT c.tie, c.code, l.url AS target, l.id AS link_id,
           CAST((""" + V.sql_fnv("c.code") + """) % 4 AS INTEGER) AS shard
    FROM clicks c LEFT JOIN links l ON c.code = l.code""", "clicks", "links"))
def q_click_enrich(spark, sf):
    out = R.click_enrich(V.clicks(spark, sf), V.links(spark, sf), shards=4)
    return out.select("tie", "code", "target", "link_id", "shard")

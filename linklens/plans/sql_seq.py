"""DuckDB oracles for the sequential operators: recursive CTEs walking each key row by row.

``src`` must provide ``key, ts, tie`` plus the columns each walker reads. The
anchor is a virtual row 0 per key with empty state; step n joins row n.
"""

from __future__ import annotations


def sliding_sql(src: str, out_cols: str = "id") -> str:
    """src columns: key, ts, tie, lim, win, id."""
    live = "list_filter(w.log, lambda v: v > s.ts - s.win)"
    return f"""
WITH RECURSIVE s0 AS ({src}),
s1 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, tie) AS rn FROM s0),
walk AS (
  SELECT key, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS log, NULL::BIGINT AS id,
         NULL::BOOLEAN AS allowed, NULL::BIGINT AS lim, NULL::BIGINT AS remaining,
         NULL::BIGINT AS reset_at, NULL::BIGINT AS retry_after_ms
  FROM (SELECT DISTINCT key FROM s1)
  UNION ALL
  SELECT s.key, s.rn,
         CASE WHEN len({live}) < s.lim THEN list_append({live}, s.ts) ELSE {live} END,
         s.id,
         len({live}) < s.lim,
         s.lim,
         CASE WHEN len({live}) < s.lim THEN s.lim - len({live}) - 1 ELSE 0 END,
         CASE WHEN len({live}) > 0 THEN ({live})[1] + s.win ELSE s.ts + s.win END,
         CASE WHEN len({live}) < s.lim THEN 0
              ELSE greatest(1, ({live})[1] + s.win - s.ts) END
  FROM walk w JOIN s1 s ON s.key = w.key AND s.rn = w.rn + 1)
SELECT {out_cols}, allowed, CAST(remaining AS BIGINT) AS remaining, CAST(reset_at AS BIGINT) AS reset_at,
       CAST(retry_after_ms AS BIGINT) AS retry_after_ms
FROM walk WHERE rn > 0"""


def bucket_sql(src: str, out_cols: str = "id") -> str:
    """src columns: key, ts, tie, cap (double), ref (double), cost (double), id."""
    t0 = "coalesce(w.tokens, s.cap)"
    el = "CAST(greatest(0, s.ts - coalesce(w.lts, s.ts)) AS DOUBLE)"
    tk = f"least(s.cap, {t0} + ({el} / 1000.0) * s.ref)"
    return f"""
WITH RECURSIVE s0 AS ({src}),
s1 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, tie) AS rn FROM s0),
walk AS (
  SELECT key, CAST(0 AS BIGINT) AS rn, NULL::DOUBLE AS tokens, NULL::BIGINT AS lts, NULL::BIGINT AS id,
         NULL::BOOLEAN AS allowed, NULL::BIGINT AS retry_after_ms, NULL::DOUBLE AS cap, NULL::DOUBLE AS ref
  FROM (SELECT DISTINCT key FROM s1)
  UNION ALL
  SELECT s.key, s.rn,
         CASE WHEN {tk} >= s.cost THEN {tk} - s.cost ELSE {tk} END,
         s.ts, s.id,
         {tk} >= s.cost,
         CASE WHEN {tk} >= s.cost THEN 0
              ELSE greatest(1, CAST(ceil(((s.cost - {tk}) / s.ref) * 1000.0) AS BIGINT)) END,
         s.cap, s.ref
  FROM walk w JOIN s1 s ON s.key = w.key AND s.rn = w.rn + 1)
SELECT {out_cols}, allowed, CAST(floor(tokens) AS BIGINT) AS remaining,
       CAST(lts + CAST(ceil(((cap - tokens) / ref) * 1000.0) AS BIGINT) AS BIGINT) AS reset_at,
       CAST(retry_after_ms AS BIGINT) AS retry_after_ms
FROM walk WHERE rn > 0"""


def ttl_sql(src: str, out_cols: str = "id") -> str:
    """src columns: key, ts, tie, ttl, kind ('read'|'fill'|'clear'), tcap (nullable), id."""
    hit = "(w.exp IS NOT NULL AND w.exp > s.ts)"
    eff = "least(s.ttl, coalesce(s.tcap, s.ttl))"
    return f"""
WITH RECURSIVE s0 AS ({src}),
s1 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, tie) AS rn FROM s0),
walk AS (
  SELECT key, CAST(0 AS BIGINT) AS rn, NULL::BIGINT AS fill, NULL::BIGINT AS exp, NULL::BIGINT AS id,
         NULL::BOOLEAN AS is_fill, NULL::BIGINT AS leader_ts, NULL::VARCHAR AS kind
  FROM (SELECT DISTINCT key FROM s1)
  UNION ALL
  SELECT s.key, s.rn,
         CASE WHEN s.kind = 'clear' THEN NULL
              WHEN s.kind = 'read' AND {hit} THEN w.fill
              WHEN {eff} > 0 THEN s.ts ELSE NULL END,
         CASE WHEN s.kind = 'clear' THEN NULL
              WHEN s.kind = 'read' AND {hit} THEN w.exp
              WHEN {eff} > 0 THEN s.ts + {eff} ELSE NULL END,
         s.id,
         CASE WHEN s.kind = 'read' THEN NOT {hit} END,
         CASE WHEN s.kind = 'read' THEN (CASE WHEN {hit} THEN w.fill ELSE s.ts END) END,
         s.kind
  FROM walk w JOIN s1 s ON s.key = w.key AND s.rn = w.rn + 1)
SELECT {out_cols}, is_fill, leader_ts FROM walk WHERE rn > 0 AND kind = 'read'"""


def inflight_sql(src: str, out_cols: str = "id") -> str:
    """src columns: key, ts (start), tie, e (end), id."""
    joins = "(w.lend IS NOT NULL AND s.ts < w.lend)"
    return f"""
WITH RECURSIVE s0 AS ({src}),
s1 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, tie) AS rn FROM s0),
walk AS (
  SELECT key, CAST(0 AS BIGINT) AS rn, NULL::BIGINT AS lstart, NULL::BIGINT AS lend, NULL::BIGINT AS id,
         NULL::BOOLEAN AS executed
  FROM (SELECT DISTINCT key FROM s1)
  UNION ALL
  SELECT s.key, s.rn,
         CASE WHEN {joins} THEN w.lstart ELSE s.ts END,
         CASE WHEN {joins} THEN w.lend ELSE s.e END,
         s.id, NOT {joins}
  FROM walk w JOIN s1 s ON s.key = w.key AND s.rn = w.rn + 1)
SELECT {out_cols}, executed, lstart AS leader_start FROM walk WHERE rn > 0"""

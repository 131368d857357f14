"""Views over the driver's test tables (see FIXTURES.md, part 2).

Each view exists twice: as a Spark DataFrame builder (what the jobs consume) and
as a DuckDB CTE body (what the independent SQL oracle consumes). The two are
written separately on purpose; the oracle must not reuse the Spark code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.functions.codecs import BASE62_ALPHABET, base62_encode

# --- fixed view parameters ---
CODE_MULTIPLIER = 2654435761  # Knuth's multiplicative constant; spreads sequential ids
MISSING_MOD, MISSING_REST = 10, 9  # keys with key % 10 = 9 have no link, so they resolve to not_found
SMALL_CREATED_MS = 1704067200000  # 2024-01-01T00:00:00Z
SMALL_EXPIRES_MS = 1705320000000  # 2024-01-15T12:00:00Z (mid-month)
DAY_MS = 86_400_000
INSTANCES = 3
# ------------------------------

TIER_OF_EVENT = {"click": "redirect", "view": "read", "signup": "write", "purchase": "write", "error": "exempt"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts_ms(col: str = "ts"):
    """Epoch ms of a TIMESTAMP_NTZ column, read as UTC."""
    return F.unix_millis(F.col(col).cast("timestamp"))


def _tier_expr():
    c = F.col("event_type")
    return (F.when(c == "click", "redirect").when(c == "view", "read")
            .when(c.isin("signup", "purchase"), "write").when(c == "error", "exempt")
            .otherwise("read"))


def _request_key():
    """Key of a request: half of the events share some hot keys, the other half has keys that grow with the users."""
    k = F.get_json_object("props", "$.k").cast("long")
    return F.when(F.col("event_id") % 2 == 0, k).otherwise(k + 100 * (1 + F.col("user_id")))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: one row per event (FIXTURES.md, `events` -> requests)."""
    ev = table(spark, sf_dir, "events")
    # `code` is computed once per row in its own projection; later columns refer to it.
    ev = ev.withColumn("k", _request_key()).withColumn("code", base62_encode((F.col("k") + 1) * F.lit(CODE_MULTIPLIER)))
    k, code = F.col("k"), F.col("code")
    et = F.col("event_type")
    path = (F.when(et == "click", F.concat(F.lit("/"), code))
            .when(et == "view", F.lit("/api/links?limit=20"))
            .when(et == "signup", F.lit("/api/links"))
            .when(et == "purchase", F.concat(F.lit("/api/links/"), code))
            .otherwise(F.lit("/health")))
    method = (F.when(et == "signup", "POST").when(et == "purchase", "DELETE").otherwise("GET"))
    status = (F.when(et == "click", 302).when(et == "view", 200).when(et == "signup", 201)
              .when(et == "purchase", 204).otherwise(503))
    return ev.select(
        F.col("event_id"),
        ts_ms("ts").alias("ts_ms"),
        F.col("event_id").alias("tie"),
        F.col("user_id").alias("client"),
        (F.col("event_id") % INSTANCES).cast("int").alias("instance"),
        et.alias("event_type"),
        _tier_expr().alias("tier"),
        (F.col("value") / 1000.0).alias("latency_s"),
        (et != "error").alias("ok"),
        (F.col("event_id") % 2).cast("int").alias("dependency"),
        k.alias("k"),
        code.alias("code"),
        path.alias("path"),
        method.alias("method"),
        status.cast("int").alias("status"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click feed: the redirect-tier requests, (code, ts_ms, tie)."""
    return (requests(spark, sf_dir).where(F.col("event_type") == "click")
            .select("code", "ts_ms", "tie", "instance"))


def request_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link table of the request log: one link per requested key, but for every tenth key; grows with `events`."""
    ev = table(spark, sf_dir, "events")
    ks = ev.select(_request_key().alias("k")).where(F.col("k") % MISSING_MOD != MISSING_REST).distinct()
    return ks.select(
        F.col("k").alias("id"),
        base62_encode((F.col("k") + 1) * F.lit(CODE_MULTIPLIER)).alias("code"),
        F.concat(F.lit("https://example.com/k/"), F.col("k").cast("string")).alias("url"),
        F.lit(SMALL_CREATED_MS).cast("long").alias("created_at"),
        F.when(F.col("k") % 5 == 0, F.lit(SMALL_EXPIRES_MS)).cast("long").alias("expires_at"),
        F.lit(0).cast("long").alias("clicks"),
        F.lit(None).cast("long").alias("last_accessed_at"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link table derived from `orders` (grows with the scale factor)."""
    o = table(spark, sf_dir, "orders")
    created = ts_ms("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"),
        base62_encode((F.col("o_orderkey") + 1) * F.lit(CODE_MULTIPLIER)).alias("code"),
        F.concat(F.lit("https://example.com/o/"), F.col("o_orderkey").cast("string")).alias("url"),
        created.alias("created_at"),
        F.when(F.col("o_orderkey") % 4 == 0, created + F.lit(30 * DAY_MS)).cast("long").alias("expires_at"),
        F.lit(0).cast("long").alias("clicks"),
        F.lit(None).cast("long").alias("last_accessed_at"),
    )


# ---------------------------------------------------------------------------
# DuckDB side (oracle). Base62 is spelled out with integer division by the
# literal powers of 62, independent of the Spark expression above.


def sql_base62(x: str) -> str:
    pows = [62 ** k for k in range(10, -1, -1)]
    parts = ", ".join(f"substr('{BASE62_ALPHABET}', CAST((({x}) // {p}) % 62 AS INTEGER) + 1, 1)" for p in pows)
    return f"CASE WHEN ({x}) >= 0 THEN regexp_replace(concat({parts}), '^0+(.)', '\\1') END"


def sql_fnv(x: str) -> str:
    return (f"list_reduce(list_prepend(2166136261::BIGINT, "
            f"list_transform(string_split({x}, ''), lambda ch: unicode(ch)::BIGINT)), "
            f"lambda a, u: (xor(a, u) * 16777619) & 4294967295)")


_RAW_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_K = f"(CASE WHEN event_id % 2 = 0 THEN {_RAW_K} ELSE {_RAW_K} + 100 * (1 + user_id) END)"

SQL_VIEWS = {
    "requests": f"""
        SELECT event_id, (epoch_us(ts) // 1000) AS ts_ms, event_id AS tie, user_id AS client,
               CAST(event_id % 3 AS INTEGER) AS instance, event_type,
               CASE event_type WHEN 'click' THEN 'redirect' WHEN 'view' THEN 'read'
                    WHEN 'signup' THEN 'write' WHEN 'purchase' THEN 'write'
                    WHEN 'error' THEN 'exempt' ELSE 'read' END AS tier,
               value / 1000.0 AS latency_s, event_type <> 'error' AS ok,
               CAST(event_id % 2 AS INTEGER) AS dependency, {_K} AS k,
               {sql_base62(f'({_K} + 1) * {CODE_MULTIPLIER}')} AS code,
               CASE event_type WHEN 'click' THEN '/' || {sql_base62(f'({_K} + 1) * {CODE_MULTIPLIER}')}
                    WHEN 'view' THEN '/api/links?limit=20' WHEN 'signup' THEN '/api/links'
                    WHEN 'purchase' THEN '/api/links/' || {sql_base62(f'({_K} + 1) * {CODE_MULTIPLIER}')}
                    ELSE '/health' END AS path,
               CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'DELETE' ELSE 'GET' END AS method,
               CAST(CASE event_type WHEN 'click' THEN 302 WHEN 'view' THEN 200 WHEN 'signup' THEN 201
                    WHEN 'purchase' THEN 204 ELSE 503 END AS INTEGER) AS status
        FROM events""",
    "clicks": "SELECT code, ts_ms, tie, instance FROM requests WHERE event_type = 'click'",
    "request_links": f"""
        SELECT k AS id, {sql_base62(f'(k + 1) * {CODE_MULTIPLIER}')} AS code,
               'https://example.com/k/' || CAST(k AS VARCHAR) AS url,
               CAST({SMALL_CREATED_MS} AS BIGINT) AS created_at,
               CAST(CASE WHEN k % 5 = 0 THEN {SMALL_EXPIRES_MS} END AS BIGINT) AS expires_at,
               CAST(0 AS BIGINT) AS clicks, CAST(NULL AS BIGINT) AS last_accessed_at
        FROM (SELECT DISTINCT {_K} AS k FROM events) WHERE k % {MISSING_MOD} <> {MISSING_REST}""",
    "links": f"""
        SELECT o_orderkey AS id, {sql_base62(f'(o_orderkey + 1) * {CODE_MULTIPLIER}')} AS code,
               'https://example.com/o/' || CAST(o_orderkey AS VARCHAR) AS url,
               (epoch_us(o_orderdate) // 1000) AS created_at,
               CAST(CASE WHEN o_orderkey % 4 = 0 THEN (epoch_us(o_orderdate) // 1000) + {30 * DAY_MS} END AS BIGINT) AS expires_at,
               CAST(0 AS BIGINT) AS clicks, CAST(NULL AS BIGINT) AS last_accessed_at
        FROM orders""",
}

# Views that depend on other views, in dependency order.
_SQL_DEPS = {"clicks": ["requests"]}


def with_views(body: str, *names: str) -> str:
    """Prefix a DuckDB query with the CTEs for the named views."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _SQL_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order)
    stripped = body.lstrip()
    if stripped[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{stripped[14:]}"
    if stripped[:4].upper() == "WITH":
        return f"WITH {ctes},\n{stripped[4:]}"
    return f"WITH {ctes}\n{body}"

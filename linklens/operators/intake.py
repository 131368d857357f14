"""Link intake and request identity: validation, audits, client identity, errors.

All rules are one ``select`` of ``when`` chains over the expressions in
:mod:`linklens.functions`; the first failing rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.functions import net as N
from linklens.functions.text import ALIAS_PATTERN, RESERVED_ALIASES, alias_error

# --- fixed values (must equal the reference) ---
ERROR_STATUS = {
    "BAD_REQUEST": 400, "VALIDATION_FAILED": 422, "UNSAFE_URL": 422, "NOT_FOUND": 404, "GONE": 410,
    "ALIAS_TAKEN": 409, "RESERVED_ALIAS": 409, "RATE_LIMITED": 429, "PAYLOAD_TOO_LARGE": 413,
    "DEPENDENCY_UNAVAILABLE": 503, "INTERNAL": 500,
}
GENERIC_5XX_MESSAGE = "Internal server error"
ALIAS_BODY_MAX = 64
API_KEY_PREFIX_CHARS = 64
# -----------------------------------------------


def validate_links(raw: DataFrame, created_at_col: str, max_expires_s: int,
                   url_col: str = "url", alias_col: str = "alias", expires_col: str = "expires_in") -> DataFrame:
    """Raw create bodies -> status, error_code, reason, normalised url, code, expires_at.

    Order: body schema (url 1..2048, alias 1..64, expiresIn positive integer) ->
    URL rules (trim, empty, length, well-formed, idn, scheme, credentials,
    blocked host) -> alias rules -> expiry bound ``max_expires_s``.
    """
    url = F.col(url_col)
    alias = F.col(alias_col)
    exp = F.col(expires_col)
    trimmed = N.js_trim(url)
    parts = N.parse_url(trimmed)
    hosted = N.whatwg_host(parts["host"])
    host = hosted["host"]
    d = raw.withColumn("_p", parts).withColumn("_h", hosted)
    p, h = F.col("_p"), F.col("_h")
    creds = p["userinfo"].rlike("[^:]")
    alias_err = alias_error(alias)
    reason = (
        F.when(url.isNull() | (F.length(url) < 1), "url_required")
        .when(F.length(url) > N.MAX_URL_LENGTH, "url_too_long")
        .when(alias.isNotNull() & ((F.length(alias) < 1) | (F.length(alias) > ALIAS_BODY_MAX)), "alias_length")
        .when(exp.isNotNull() & (exp <= 0), "expires_in")
        .when(F.length(trimmed) == 0, "url_required")
        .when(F.length(trimmed) > N.MAX_URL_LENGTH, "url_too_long")
        .when(~p["ok"] | (p["special"] & ~h["ok"]), "url_malformed")
        .when(~p["scheme"].isin(N.ALLOWED_SCHEMES), "scheme")
        .when(h["host"].rlike(r"[^\x00-\x7F]"), "idn")
        .when(h["host"] == "", "no_host")
        .when(creds, "credentials")
        .when(N.blocked_reason(h["host"]).isNotNull(), "blocked_host")
        .when(alias.isNotNull() & alias_err.isNotNull(),
              F.when(alias_err == "RESERVED_ALIAS", "alias_reserved").otherwise("alias_invalid"))
        .when(exp.isNotNull() & (exp > max_expires_s), "expires_in_max"))
    code = (F.when(reason.isin("scheme", "credentials", "blocked_host"), "UNSAFE_URL")
            .when(reason == "alias_reserved", "RESERVED_ALIAS")
            .when(reason.isNotNull(), "VALIDATION_FAILED"))
    d = d.withColumn("reason", reason).withColumn("error_code", code)
    return d.select(
        *raw.columns,
        F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("status"),
        "error_code", "reason",
        F.when(F.col("reason").isNull(), N.normalise_url(p, host)).alias("norm_url"),
        F.when(F.col("reason").isNull(), F.trim(alias)).alias("code"),
        F.when(F.col("reason").isNull() & exp.isNotNull(),
               F.col(created_at_col) + exp.cast("long") * 1000).alias("expires_at"),
    )


def unsafe_targets(links: DataFrame, url_col: str = "url") -> DataFrame:
    """Stored links whose target host is private / loopback / link-local / metadata, with reason."""
    d = links.withColumn("_p", N.parse_url(N.js_trim(F.col(url_col))))
    d = d.withColumn("_h", N.whatwg_host(F.col("_p")["host"]))
    d = d.withColumn("host", F.col("_h")["host"]).withColumn("reason", N.blocked_reason(F.col("_h")["host"]))
    return d.where(F.col("_p")["ok"] & F.col("reason").isNotNull()).drop("_p", "_h")


def reserved_aliases(codes: DataFrame, code_col: str = "code") -> DataFrame:
    """Codes colliding with the reserved namespace: broadcast left-semi join on lower(code).

    The reserved table is the fixed 36-word list, so broadcasting it is bounded.
    """
    spark = codes.sparkSession
    reserved = spark.createDataFrame([(w,) for w in RESERVED_ALIASES], "word string")
    return codes.join(F.broadcast(reserved), F.lower(F.col(code_col)) == F.col("word"), "left_semi")


def cidr_table(spark, cidrs: list[str]) -> DataFrame:
    """Trusted proxy CIDRs -> (cidr, lo, hi) for v4 and (cidr, prefix) for v6; malformed rows skipped."""
    df = spark.createDataFrame([(c,) for c in cidrs], "cidr string")
    b = N.cidr_bounds("cidr")
    v6_prefix = F.regexp_replace(F.lower(F.substring_index("cidr", "/", 1)), "::$", "")
    return df.select("cidr", b["lo"].alias("lo"), b["hi"].alias("hi"),
                     F.when(F.col("cidr").contains(":"), v6_prefix).alias("v6_prefix")).where(
        F.col("lo").isNotNull() | F.col("v6_prefix").isNotNull())


def _match_keys(ip_col: str | Column, v4_lengths: Sequence[int], v6_lengths: Sequence[int]) -> Column:
    """array<struct<bits, key>>: what an address is looked up by, one entry for each prefix length in use.

    v4 (also v4-mapped): the network of that many bits. v6: the first characters
    of its lower-case text, as v6 entries match by literal or prefix.
    """
    norm = F.lower(F.regexp_replace(ip_col, r"(?i)^::ffff:", ""))
    ip = N.ipv4_loose(norm)

    def entry(bits: int, key: Column) -> Column:
        return F.struct(F.lit(bits).alias("bits"), key.alias("key"))

    none = F.array().cast("array<struct<bits:int,key:string>>")
    v4 = F.array(*[entry(n, F.concat(F.lit(f"4/{n}/"), (ip - F.pmod(ip, F.lit(1 << (32 - n)))).cast("string"))) for n in v4_lengths])
    v6 = F.array(*[entry(n, F.concat(F.lit(f"6/{n}/"), F.substring(norm, 1, n))) for n in v6_lengths])
    return F.when(ip.isNotNull(), v4 if v4_lengths else none).when(norm.contains(":"), v6 if v6_lengths else none).otherwise(none)


def _keyed(cidrs: DataFrame) -> DataFrame:
    """CIDR table with family, bits (v6: characters) and the key that addresses inside have."""
    size = F.col("hi") - F.col("lo") + 1
    v4 = F.col("lo").isNotNull()
    bits = F.when(v4, 32 - F.round(F.log2(size))).otherwise(F.length("v6_prefix")).cast("int")
    k = cidrs.withColumn("family", F.when(v4, 4).otherwise(6)).withColumn("bits", bits)
    return k.withColumn("key", F.concat_ws("/", "family", "bits", F.when(v4, F.col("lo").cast("string")).otherwise(F.col("v6_prefix"))))


def _lengths(keyed: DataFrame) -> tuple[list[int], list[int]]:
    """Prefix lengths in use: at most 33 and 46 numbers, whatever the size of the table."""
    found = {(r.family, r.bits) for r in keyed.where((F.col("family") == 4) | (F.col("bits") < 46)).select("family", "bits").distinct().collect()}
    return sorted(b for f, b in found if f == 4), sorted(b for f, b in found if f == 6)


def trusted_peers(peers: DataFrame, cidrs: DataFrame, ip_col: str = "peer") -> DataFrame:
    """Each distinct peer address with the longest prefix that holds it (``matched_cidr``; ties: the least text), and
    whether there is one.

    Longest-prefix match by one equi-join: an address has one key for each prefix
    length in use, so the table of prefixes may be of any size.
    """
    keyed = _keyed(cidrs)
    p = peers.select(ip_col).distinct()
    keys = p.select(ip_col, F.explode(_match_keys(ip_col, *_lengths(keyed))).alias("m")).select(ip_col, "m.bits", "m.key")
    best = keys.join(keyed.groupBy("key").agg(F.min("cidr").alias("cidr")), "key").groupBy(ip_col).agg(
        F.max_by("cidr", "bits").alias("matched_cidr"))
    out = p.withColumnRenamed(ip_col, "_peer").join(best, F.col("_peer").eqNullSafe(F.col(ip_col)), "left")
    return out.select(F.col("_peer").alias(ip_col), "matched_cidr", F.col("matched_cidr").isNotNull().alias("trusted"))


def is_trusted(peer: str | Column, cidrs: DataFrame) -> Column:
    """Whether an address is in a trusted network, as an expression on the row; ``cidrs``: the configuration's table.

    The keys of the configured networks become one set in the plan; a row looks
    up its own few keys. No join, no shuffle. For tables too large for a
    configuration use :func:`trusted_peers`.
    """
    keyed = _keyed(cidrs)
    known = sorted(r.key for r in keyed.select("key").distinct().collect())
    if not known:
        return F.lit(False)
    return F.coalesce(F.exists(_match_keys(peer, *_lengths(keyed)), lambda m: m["key"].isin(known)), F.lit(False))


def client_identity(req: DataFrame, cidrs: DataFrame, peer="peer", xff="xff", api_key="api_key") -> DataFrame:
    """Identity charged for a request: api key, else trusted-proxy forwarded client, else peer.

    ``cidrs``: the configured networks (:func:`cidr_table`). A pure projection of the requests.
    """
    first = F.trim(F.split(F.col(xff), ",").getItem(0))
    ident = (F.when(F.col(api_key).isNotNull() & (F.length(api_key) > 0),
                    F.concat(F.lit("apikey:"), F.substring(F.col(api_key), 1, API_KEY_PREFIX_CHARS)))
             .when(is_trusted(peer, cidrs) & F.col(xff).isNotNull() & (F.length(xff) > 0)
                   & (F.length(first) > 0), F.concat(F.lit("ip:"), first))
             .otherwise(F.concat(F.lit("ip:"), F.coalesce(F.col(peer), F.lit("0.0.0.0")))))
    return req.withColumn("client_id", ident)


def classify_errors(errors: DataFrame, code_col: str = "error_code", status_col: str = "raw_status",
                    message_col: str = "message") -> DataFrame:
    """Error code -> HTTP status and envelope code; 5xx messages replaced.

    Foreign errors keep a status of 400..599, else get 500; those of 400..499 are a ``BAD_REQUEST`` with their own
    message, the others ``INTERNAL``.
    """
    m = F.create_map(*[x for kv in ERROR_STATUS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    known = F.try_element_at(m, F.col(code_col))
    raw = F.col(status_col)
    status = F.coalesce(known, F.when(raw.between(400, 599), raw), F.lit(500)).cast("int")
    code = F.when(known.isNotNull(), F.col(code_col)).when(raw.between(400, 499), "BAD_REQUEST").otherwise("INTERNAL")
    return errors.withColumn("http_status", status).withColumn("envelope_code", code).withColumn(
        "exposed_message", F.when(F.col("http_status") < 500, F.col(message_col)).otherwise(F.lit(GENERIC_5XX_MESSAGE)))


def error_envelope(classified: DataFrame, request_id: str, details: str, code_col: str = "error_code") -> DataFrame:
    """Adds ``envelope``: the JSON {"error": {code, message, requestId, details}} of rows of :func:`classify_errors`.

    ``details`` is a map of texts; it stands in the envelope of known codes only, and is left out when null or empty.
    """
    known = F.col(code_col).isin(*ERROR_STATUS)
    said = F.when(known & (F.size(F.coalesce(details, F.create_map().cast("map<string,string>"))) > 0), F.col(details))
    body = F.struct(F.col("envelope_code").alias("code"), F.col("exposed_message").alias("message"),
                    F.col(request_id).alias("requestId"), said.alias("details"))
    return classified.withColumn("envelope", F.to_json(F.struct(body.alias("error"))))

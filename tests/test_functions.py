"""Literal vectors for the per-row expressions (the reference's unit-test vectors)."""

import base64

from pyspark.sql import functions as F

from linklens.functions import codecs as C
from linklens.functions import net as N
from linklens.functions import text as X


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_base62_vectors(spark):
    vectors = {0: "0", 1: "1", 10: "A", 61: "z", 62: "10", 3843: "zz"}
    df = spark.createDataFrame([(k,) for k in vectors], "v long")
    got = dict(df.select("v", C.base62_encode("v").alias("c")).collect())
    assert got == vectors
    assert one(spark, C.base62_encode("v"), -1, "v long") is None


def test_base62_round_trip_large(spark):
    n = 9223372036854775806
    code = one(spark, C.base62_encode("v"), n, "v long")
    assert one(spark, C.base62_decode("v"), code) == n
    assert one(spark, C.base62_decode("v"), "a-b") is None
    assert one(spark, C.base62_decode("v"), "") is None
    assert one(spark, C.base62_decode("v"), "zzzzzzzzzzzzz") is None  # overflow


def test_base62_property(spark):
    df = spark.range(0, 100_000).select((F.col("id") * 7919 + 13).alias("n"))
    bad = df.select("n", C.base62_decode(C.base62_encode("n")).alias("m")).where(F.col("n") != F.col("m")).count()
    assert bad == 0
    assert df.select(C.base62_encode("n").alias("c")).distinct().count() == 100_000


def test_fnv_vectors(spark):
    assert one(spark, C.fnv1a32("v"), "") == 0x811C9DC5
    assert one(spark, C.fnv1a32("v"), "a") == 0xE40C292C
    assert one(spark, C.fnv1a32("v"), "foobar") == 0xBF9CF968
    assert C.fnv1a32_literal("foobar") == 0xBF9CF968


def test_shard_spread(spark):
    df = spark.range(10_000).select(C.base62_encode(F.col("id") * 2654435761).alias("code"))
    counts = [r["n"] for r in df.groupBy(C.bucket_of("code", 4).alias("b")).agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 4
    assert all(abs(c - 2500) <= 125 for c in counts)


def test_snowflake_parts(spark):
    i = one(spark, C.snowflake_id(F.lit(1800000000000), F.lit(3), F.lit(5)), 0, "v long")
    row = spark.createDataFrame([(i,)], "v long").select(C.snowflake_ts("v"), C.snowflake_node("v"),
                                                         C.snowflake_seq("v")).first()
    assert tuple(row) == (1800000000000, 3, 5)


def test_cursor_round_trip_and_malformed(spark):
    cur = one(spark, C.encode_cursor(F.lit(1700000000000), F.lit("123456789")), 0, "v long")
    assert cur == base64.urlsafe_b64encode(b"1700000000000:123456789").decode().rstrip("=")
    dec = one(spark, C.decode_cursor("v"), cur)
    assert dec["created_at"] == 1700000000000 and dec["id"] == "123456789"
    for bad in ["not-base64!!!", "", base64.urlsafe_b64encode(b"nocolon").decode().rstrip("=")]:
        assert one(spark, C.decode_cursor("v"), bad) is None


def test_alias_rules(spark):
    assert one(spark, X.alias_error("v"), "My-Link_1") is None
    for bad in ["ab", "x" * 33, "has space", "a/b"]:
        assert one(spark, X.alias_error("v"), bad) == "VALIDATION_FAILED"
    assert one(spark, X.alias_error("v"), "api") == "RESERVED_ALIAS"
    assert one(spark, X.alias_error("v"), "API") == "RESERVED_ALIAS"


def test_mask_and_escape(spark):
    assert one(spark, X.mask_secret("v"), "hunter2") == "***"
    assert one(spark, X.mask_secret("v"), "sk_live_abcdefghijklmnop") == "sk_l***op"
    assert one(spark, X.escape_label("v"), 'a"b\\c\n') == 'a\\"b\\\\c\\n'


def test_hosts(spark):
    cases = {"127.1": "127.0.0.1", "0x7f.1": "127.0.0.1", "2130706433": "127.0.0.1", "example.com": "example.com"}
    for h, want in cases.items():
        assert one(spark, N.whatwg_host("v")["host"], h) == want
    for h in ["localhost", "x.internal", "10.1.2.3", "169.254.169.254", "[::1]", "[fe80::1]", "192.0.5.5", "224.0.0.1"]:
        assert one(spark, N.blocked_reason("v"), h) is not None, h
    assert one(spark, N.blocked_reason("v"), "8.8.8.8") is None


def test_validate_urls(spark):
    from linklens.operators.intake import validate_links

    rows = [("https://example.com/a/b?c=d", None, None), ("  http://example.com  ", None, None),
            ("HTTPS://Example.COM/Path", None, None), ("javascript:alert(1)", None, None),
            ("http://user:pw@example.com/", None, None), ("http://127.1/", None, None),
            ("not a url", None, None), ("", None, None), ("https://example.com/" + "a" * 2100, None, None),
            ("https://example.com/x/../y/./z", "api", None), ("https://example.com:443/", None, 3600)]
    df = spark.createDataFrame(rows, "url string, alias string, expires_in long").withColumn("created_at", F.lit(0))
    out = {r["url"]: r for r in validate_links(df, "created_at", 86400).collect()}
    assert out["https://example.com/a/b?c=d"]["norm_url"] == "https://example.com/a/b?c=d"
    assert out["  http://example.com  "]["norm_url"] == "http://example.com/"
    assert out["HTTPS://Example.COM/Path"]["norm_url"] == "https://example.com/Path"
    assert out["javascript:alert(1)"]["error_code"] == "UNSAFE_URL"
    assert out["http://user:pw@example.com/"]["reason"] == "credentials"
    assert out["http://127.1/"]["reason"] == "blocked_host"
    assert out["not a url"]["reason"] == "url_malformed"
    assert out[""]["reason"] == "url_required"
    assert out["https://example.com/x/../y/./z"]["error_code"] == "RESERVED_ALIAS"
    ok = out["https://example.com:443/"]
    assert ok["status"] == "accepted" and ok["norm_url"] == "https://example.com/" and ok["expires_at"] == 3600000

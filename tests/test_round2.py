"""IPv6 targets, dot segments, odd casts, exposition numbers, errors, logs, shards, null keys, out-of-order streams."""

from pyspark.sql import functions as F

from linklens.functions import codecs as C
from linklens.functions import net as N
from linklens.operators import intake as I
from linklens.operators import links as L
from linklens.operators import paging as P
from linklens.operators import sequential as S
from linklens.plans import views as V
from linklens.session import scratch_path
from linklens.sources import exposition as X
from linklens.sources import links_io as LI
from linklens.sources import logs as LG
from linklens.streaming import jobs as J

from conftest import SF


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


def test_ipv6_targets(spark):
    urls = {"http://[::1]/": "private_ipv6", "http://[fd00::1]/": "private_ipv6", "http://[fe80::1]:80/": "private_ipv6",
            "http://[::ffff:10.0.0.1]/": "private_ipv6", "http://[::ffff:7f00:1]/": "private_ipv6",
            "http://[0:0:0:0:0:0:0:0]/": "private_ipv6", "http://[2606:4700::1111]/": None, "http://8.8.8.8/": None,
            "http://[::ffff:8.8.8.8]/": None, "http://192.168.1.1/": "private_ipv4", "http://localhost/": "blocked_name"}
    df = spark.createDataFrame([(u,) for u in urls], "u string").withColumn("p", N.parse_url("u"))
    got = {r.u: r.b for r in df.select("u", N.blocked_reason(N.whatwg_host(F.col("p")["host"])["host"]).alias("b")).collect()}
    assert got == urls
    bad = spark.createDataFrame([(u, None, None, 0) for u in ("http://[zzz]/", "http://[::1", "http://[1:2:3]/",
                                                              "http://[1:2:3:4:5:6:7::8]/")],
                                "url string, alias string, expires_in bigint, at bigint")
    assert {r.reason for r in I.validate_links(bad, "at", 10).collect()} == {"url_malformed"}
    ok = spark.createDataFrame([("http://[2001:DB8:0:0:1:0:0:1]:8080/a", None, None, 0)],
                               "url string, alias string, expires_in bigint, at bigint")
    assert I.validate_links(ok, "at", 10).first().norm_url == "http://[2001:db8::1:0:0:1]:8080/a"


def test_dot_segments(spark):
    want = {"/a/..": "/", "/.": "/", "/a/b/.%2e": "/a/", "/a/./b": "/a/b", "/a/b/..": "/a/", "/": "/", "/a/%2E%2e/c": "/c"}
    assert {p: one(spark, p, N.remove_dot_segments) for p in want} == want


def test_long_octets_do_not_throw(spark):
    assert one(spark, "1.2.3." + "9" * 20, N.ipv4_loose) is None
    assert one(spark, "1.2.3." + "9" * 20, N.ipv4_strict) is None
    assert one(spark, "1.2.3." + "9" * 20 + "/8", N.cidr_bounds) is None


def test_exposition_numbers_and_labels(spark):
    want = {0.00012: "0.00012", 1.5: "1.5", 3.0: "3", float("inf"): "+Inf", float("-inf"): "-Inf", 1e-5: "0.00001"}
    assert {v: one(spark, v, X.fmt_number, "double") for v in want} == want
    lines = spark.createDataFrame([('m{a="1",a="2",b="x"} 5',)], "value string")
    assert X.parse(lines).first().labels == {"a": "1", "b": "x"}


def test_foreign_errors(spark):
    rows = spark.createDataFrame([("X", 404, "m"), ("X", 503, "m"), ("X", 200, "m"), ("GONE", 1, "m")],
                                 "error_code string, raw_status int, message string")
    got = [(r.http_status, r.envelope_code, r.exposed_message) for r in I.classify_errors(rows).collect()]
    hidden = I.GENERIC_5XX_MESSAGE
    assert got == [(404, "BAD_REQUEST", "m"), (503, "INTERNAL", hidden), (500, "INTERNAL", hidden), (410, "GONE", "m")]


def test_retried_upstreams_and_redacted_maps(spark):
    line = ('1.2.3.4 - [01/Jan/2024:00:00:00 +0000] "GET /x HTTP/1.1" 200 5 rt=0.2 upstream=10.0.0.1:80, 10.0.0.2:80 '
            "urt=0.1, 0.05 cache=MISS rid=ab")
    r = LG.parse_access_log(spark.createDataFrame([(line,)], "value string")).first()
    assert r.parse_ok and r.upstream == "10.0.0.1:80, 10.0.0.2:80" and r.urt == 0.05 and r.request_id == "ab"
    df = spark.sql("SELECT struct(map('password', 5L, 'n', 6L) AS m, map('x', named_struct('token', 'abc')) AS s) AS c")
    c = LG.redact_log(df, "c").first().c
    assert c.m == {"password": "***", "n": "6"} and c.s["x"]["token"] == "***"


def test_empty_shards_are_read(spark):
    links = V.links(spark, SF).limit(1)
    path = LI.stage_sharded(links, 4, "one")
    assert LI.union_shards(spark, path, 4).count() == 1


def test_cursor_reaches_the_scan(spark):
    links = LI.read_links(spark, LI.stage_sharded(V.links(spark, SF), 2, "cursor"))
    cursor = P.list_page(links, 10).collect()[-1]["next_cursor"]
    plan = P.after_cursor(links, cursor)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
    assert C.decode_cursor_literal("!!") is None


def test_hash_of_wide_characters(spark):
    for text in ("", "abc", "é日", "a\U0001F600b"):
        assert one(spark, text, C.fnv1a32) == C.fnv1a32_literal(text)


def test_null_keys_and_limit_zero(spark):
    rows = spark.createDataFrame([(None, 0, 1), (None, 10, 2), (None, 20, 3), (None, 4_000_000, 4)],
                                 "k bigint, ts bigint, tie bigint")
    got = {r.tie: r.allowed for r in S.sliding_window_limit(rows, "k", "ts", "tie", 1, 10_000_000).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    none = S.sliding_window_limit(rows, "k", "ts", "tie", 0, 1000).collect()
    assert [(r.allowed, r.reset_at) for r in sorted(none, key=lambda r: r.tie)] == [
        (False, 1000), (False, 1010), (False, 1020), (False, 4_001_000)]


def test_out_of_order_files_lose_nothing(spark):
    """Four files in the wrong order: rows in = rows out for counts and limiters."""
    r = V.requests(spark, SF).select("event_id", "client", "code", "ts_ms", "tie")
    path = scratch_path(spark, f"order-{id(r)}")
    for part in (2, 0, 3, 1):
        r.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(path)
    n = r.count()
    stream = lambda: J.click_source(spark, path, r.schema)
    counts = J.total_counts(spark.read.parquet(J.run_batches(stream(), "o1", "append", J.click_counts())))
    assert counts.agg(F.sum("count")).first()[0] == n
    for name, job in (("o2", J.stream_sliding_limit(stream(), "client", 5, 60_000)),
                      ("o3", J.stream_token_bucket(stream(), "client", 5.0, 1.0))):
        out = spark.read.parquet(J.run_batches(job, name, "append"))
        assert out.select("event_id").distinct().count() == out.count() == n


def test_a_replayed_flush_counts_once(spark):
    links = V.request_links(spark, SF)
    root = scratch_path(spark, f"replay-{id(links)}")
    clicks = V.clicks(spark, SF)
    step = J.apply_flushes(links, root)
    first, second = clicks.where("tie % 2 = 0"), clicks.where("tie % 2 = 1")
    for batch, i in ((first, 0), (second, 1), (second, 1)):
        step(batch, i)
    known = clicks.join(links, "code", "left_semi").count()
    assert spark.read.parquet(f"{root}/version=1").agg(F.sum("clicks")).first()[0] == known


def test_first_arrival_wins(spark):
    stored = spark.createDataFrame([("a",), (None,)], "code string")
    batch = spark.createDataFrame(
        [(1, "a", 5), (2, "b", 7), (3, "b", 6), (4, None, 1), (5, None, 2), (6, "c", None), (7, "c", 3), (8, "d", 1),
         (8, "d", 1)], "id long, code string, created_at long")
    out = [(r["id"], r["status"]) for r in L.insert_unique(stored, batch).collect()]
    assert len(out) == 9
    assert sorted(i for i, status in out if status == "inserted") == [3, 4, 6, 8]
    assert L.insert_unique(stored, batch.limit(0)).count() == 0


def test_page_walk_differences(spark):
    schema = "id long, code string"
    table = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], schema)
    paged = spark.createDataFrame([(1, "a"), (2, None), (2, None), (4, "c")], schema)
    assert tuple(P.page_walk_check(table, paged).first()) == (4, 4, 2, 2, 1)
    assert tuple(P.page_walk_check(table.limit(0), paged.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_flushes_hold_few_codes(spark):
    rows = [(f"c{i % 7}", i) for i in range(50)] + [(None, 1)]
    out = J.bounded_flushes(3)(spark.createDataFrame(rows, "code string, ts_ms long"), 5).collect()
    assert sorted(r["codes"] for r in out) == [2, 3, 3]
    assert sum(r["clicks"] for r in out) == 51
    assert {r["batch_id"] for r in out} == {5}


def test_negative_touch_lets_spark_choose_the_join(spark):
    from linklens.plans import q_seq

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = q_seq._negative_events(spark, SF)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "LeftAnti" in plan and "strategy=broadcast" not in plan and "BroadcastHashJoin" not in plan

"""Recorded counters, exposition of any samples, longest-prefix match, error envelopes."""

import ipaddress
import json

import pytest
from pyspark.sql import functions as F

from linklens.operators import counters as C
from linklens.operators import intake as I
from linklens.sources import exposition as X

NAMES = {"q": C.REQUESTS, "c": C.CACHE_EVENTS, "s": C.SHARD_QUERIES}


def samples(spark, rows):
    return spark.createDataFrame([(i, NAMES[n], labels, at, float(v)) for i, n, labels, at, v in rows],
                                 "instance int, name string, labels map<string,string>, scrape_ms bigint, value double")


def test_growth_between_scrapes(spark):
    code, other = {"route": "/:code"}, {"route": "/health"}
    find, insert = {"operation": "findByCode", "shard": "1"}, {"shard": "1", "operation": "insert"}
    rows = [(0, "q", code, 10, 100), (0, "q", code, 20, 300), (1, "q", code, 20, 50), (0, "q", other, 20, 999),
            (0, "s", find, 10, 40), (0, "s", find, 20, 60), (1, "s", find, 20, 5), (0, "s", insert, 20, 500),
            (0, "c", {"tier": "l1", "outcome": "hit"}, 20, 30), (0, "c", {"outcome": "miss", "tier": "l1"}, 20, 10),
            (0, "c", {"tier": "l2", "outcome": "negative"}, 20, 10), (0, "q", code, 30, 10**6)]
    s = samples(spark, rows)
    run = C.counter_growth(s, 10, 20)
    assert C.cache_effectiveness(run).first().asDict() == {"requests": 250, "lookups": 25, "effectiveness": 90.0}
    assert [tuple(r) for r in C.tier_hit_ratio(run).collect()] == [("l1", 30, 10, 75.0)]  # l2 was never consulted
    assert C.cache_effectiveness(C.counter_growth(s)).first().requests == 10**6 + 50
    none = C.counter_growth(s.limit(0))
    assert C.cache_effectiveness(none).first().asDict() == {"requests": 0, "lookups": 0, "effectiveness": 0.0}
    assert C.tier_hit_ratio(none).count() == 0


def test_exposition_order_and_round_trip(spark):
    scalar = spark.createDataFrame([("b_total", {"z": '1"\n\\', "a": "x"}, 5.0), ("b_total", None, 7.5), ("b_total", {}, 1.0)][:2],
                                   "metric string, labels map<string,string>, value double")
    gauge = spark.createDataFrame([("a_now", {"i": str(i)}, i / 8) for i in range(12)],
                                  "metric string, labels map<string,string>, value double")
    hist = spark.createDataFrame([("h_s", "histogram", labels, None, [(le, 3) for le in (10.0, 2.5, 0.5)], 9.25, 4)
                                  for labels in (None, {"r": "x"})], X.SAMPLES)
    every = X.scalar_samples(scalar, "counter").unionByName(X.scalar_samples(gauge, "gauge")).unionByName(hist)
    lines = [r.line for r in X.render(every.repartition(7), {"a_now": "Now", "h_s": "Time"}).collect()]
    assert lines[:4] == ["# HELP a_now Now", "# TYPE a_now gauge", 'a_now{i="0"} 0', 'a_now{i="1"} 0.125']
    assert lines[14:17] == ["# TYPE b_total counter", "b_total 7.5", 'b_total{a="x",z="1\\"\\n\\\\"} 5']
    assert lines[17:] == ["# HELP h_s Time", "# TYPE h_s histogram",
                          *[f'h_s_bucket{{le="{le}"}} {n}' for le, n in (("0.5", 3), ("2.5", 3), ("10", 3), ("+Inf", 4))],
                          "h_s_sum 9.25", "h_s_count 4",
                          *[f'h_s_bucket{{r="x",le="{le}"}} {n}' for le, n in (("0.5", 3), ("2.5", 3), ("10", 3), ("+Inf", 4))],
                          'h_s_sum{r="x"} 9.25', 'h_s_count{r="x"} 4']
    back = {(r.name, tuple(sorted(r.labels.items()))): r.value
            for r in X.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert back[("b_total", (("a", "x"), ("z", '1"\n\\')))] == 5.0 and back[("b_total", ())] == 7.5
    assert back[("h_s_bucket", (("le", "+Inf"), ("r", "x")))] == 4.0 and len(back) == 2 + 12 + 2 * 6
    assert X.render(every.limit(0)).count() == 0


def test_longest_prefix(spark):
    nets = ["10.0.0.0/8", "10.1.0.0/16", "10.1.2.3", "10.1.2.0/24", "0.0.0.0/1", "fd00::", "fd00:1::", "300.1.1.1/8", "nonsense"]
    cidrs = I.cidr_table(spark, nets)
    ips = ["10.1.2.3", "::ffff:10.1.2.9", "10.1.3.1", "10.9.9.9", "9.9.9.9", "200.1.1.1", "FD00:1::5", "fd00:2::5", "fe80::1",
           "junk", "", None]
    got = {r.peer: r.matched_cidr for r in I.trusted_peers(spark.createDataFrame([(i,) for i in ips * 2], "peer string"), cidrs).collect()}
    v4 = [ipaddress.ip_network(n) for n in nets[:5]]

    def want(ip):
        inside = [n for n in v4 if ipaddress.ip_address(ip) in n]
        return max(inside, key=lambda n: n.prefixlen) if inside else None

    for ip in ips[:6]:
        w = want(ip.replace("::ffff:", ""))
        assert (None if got[ip] is None else ipaddress.ip_network(got[ip])) == w
    assert (got["FD00:1::5"], got["fd00:2::5"], got["fe80::1"], got["junk"], got[""], got[None]) == (
        "fd00:1::", "fd00::", None, None, None, None)
    peers = spark.createDataFrame([(i, " 1.1.1.1 , 2.2.2.2", None) for i in ips], "peer string, xff string, api_key string")
    out = I.client_identity(peers, cidrs)
    assert {r.peer: r.client_id for r in out.collect()} == {
        i: "ip:1.1.1.1" if got[i] else f"ip:{'0.0.0.0' if i is None else i}" for i in ips}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert I.trusted_peers(peers, cidrs.limit(0)).where("trusted").count() == 0


@pytest.mark.parametrize("code,status,details,want", [
    ("GONE", None, {"k": 'v"'}, {"code": "GONE", "message": "m", "requestId": "r", "details": {"k": 'v"'}}),
    ("GONE", None, {}, {"code": "GONE", "message": "m", "requestId": "r"}),
    ("INTERNAL", None, {"k": "v"}, {"code": "INTERNAL", "message": I.GENERIC_5XX_MESSAGE, "requestId": "r", "details": {"k": "v"}}),
    ("X", 404, {"k": "v"}, {"code": "BAD_REQUEST", "message": "m", "requestId": "r"}), ("X", 200, None, {
        "code": "INTERNAL", "message": I.GENERIC_5XX_MESSAGE, "requestId": "r"})])
def test_envelopes(spark, code, status, details, want):
    row = spark.createDataFrame([(code, status, "m", "r", details)],
                                "error_code string, raw_status int, message string, rid string, d map<string,string>")
    out = I.error_envelope(I.classify_errors(row), "rid", "d").select(F.col("envelope")).first()[0]
    assert json.loads(out) == {"error": want}


def test_log_bindings(spark):
    from linklens.sources import logs as LG

    lines = ['{"ts":"t","level":"info","msg":"m","peer":{"a":1},"n":5,"gone":null,"s":"x y"}', '{"level":"info","bro',
             '{"level":"debug","n":1}', '{"level":"warn"}', ""]
    out = LG.structured_log(spark.createDataFrame([(x,) for x in lines], "value string"), bindings="more").collect()
    assert [(r.level, r.more) for r in out] == [("info", {"peer": '{"a":1}', "n": "5", "gone": None, "s": "x y"}), ("warn", {})]

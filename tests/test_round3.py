"""Minting statuses, versioned shards, window audits, selection of quantiles."""

import math
import uuid

from pyspark.sql import functions as F

from linklens.operators import ids as D
from linklens.operators import links as L
from linklens.operators import metrics as M
from linklens.operators import paging as P
from linklens.operators import sequential as S
from linklens.session import scratch_path
from linklens.sources.links_io import LINK_SCHEMA
from linklens.sources.versions import VersionedLinks, reap, shards_of
from linklens.streaming import jobs as J

EPOCH = 1704067200000


def test_mint_rejects_what_would_collide(spark):
    rows = [(1, 0, EPOCH + 1), (2, 1024, EPOCH), (3, -1, EPOCH), (4, None, EPOCH), (5, 0, EPOCH - 1), (6, 0, None), (7, 1023, EPOCH)]
    df = spark.createDataFrame(rows, "tie bigint, node bigint, ms bigint")
    got = {r.tie: (r.status, r.id, r.code, r.seq) for r in D.mint_ids(df, "node", "ms", "tie").collect()}
    assert {t: s for t, (s, *_) in got.items()} == {1: "ok", 2: "invalid_node", 3: "invalid_node", 4: "invalid_node",
                                                    5: "before_epoch", 6: "invalid_time", 7: "ok"}
    assert got[1][1] == 1 << 22 and got[7][1] == 1023 << 12
    assert all(rest == (None, None, None) for s, *r in got.values() for rest in [tuple(r)] if s != "ok")


def links(spark, n=40):
    rows = [(i, f"c{i}", f"https://example.com/{i}", 1000 + i, 5000 if i % 4 == 0 else None, 0, None) for i in range(n)]
    return spark.createDataFrame(rows, LINK_SCHEMA)


def files(table):
    return {(s, v): {f.getPath().toString() for f in table._files().listStatus(table._path("data", f"v={v}", f"shard={s}"))}
            for s, v, _ in table.manifest()}


def test_reap_rewrites_only_shards_with_expired_links(spark):
    all_links = links(spark)
    shard_of = {r.code: r.shard for r in all_links.withColumn("shard", F.lit(0)).select("code", "shard").collect()}
    table = VersionedLinks(spark, scratch_path(spark, f"versions-reap-{uuid.uuid4().hex}"), 4, LINK_SCHEMA)
    table.create(all_links)
    shard_of = {r.code: r.shard for r in table.read().collect()}
    assert len(shard_of) == 40
    # one expired link only
    table.commit(1, set(range(4)), lambda rows: rows.withColumn("expires_at", F.when(F.col("code") == "c8", 5000).cast("bigint")))
    before = files(table)
    version, report = reap(table, 5000)
    after = files(table)
    hit = shard_of["c8"]
    assert version == 2 and {r.shard for r in report.collect() if r.rewritten} == {hit}
    assert {k: v for k, v in before.items() if k[0] != hit} == {k: v for k, v in after.items() if k[0] != hit}
    assert (hit, 2) in after and {r.code for r in table.read().collect()} == set(shard_of) - {"c8"}
    assert reap(table, 5000)[1].where("rewritten").count() == 0
    # a shard that loses all its links has no files any more
    table.commit(4, {hit}, lambda rows: rows.where("false"))
    assert hit not in {s for s, _, _ in table.manifest()} and table.read(4, {hit}).count() == 0
    assert table.vacuum(1) and table.versions() == [4]
    assert {r.code for r in table.read().collect()} == {c for c, s in shard_of.items() if s != hit}


def test_replayed_flush_counts_once(spark):
    table = VersionedLinks(spark, scratch_path(spark, f"versions-flush-{uuid.uuid4().hex}"), 4, LINK_SCHEMA)
    table.create(links(spark))
    flush = J.commit_flushes(table)
    clicks = spark.createDataFrame([("c1", 7000, 1), ("c1", 8000, 2), ("unknown", 1, 3)], "code string, ts_ms bigint, tie bigint")
    flush(clicks, 0)
    more = spark.createDataFrame([("c2", 9000, 1)], "code string, ts_ms bigint, tie bigint")
    flush(more, 1)
    first = {r.code: (r.clicks, r.last_accessed_at) for r in table.read().collect()}
    flush(more, 1)  # the same micro-batch again
    assert {r.code: (r.clicks, r.last_accessed_at) for r in table.read().collect()} == first
    assert first["c1"] == (2, 8000) and first["c2"] == (1, 9000) and first["c3"] == (0, None)
    touched = shards_of(more, 4)
    assert {s for s, v, _ in table.manifest() if v == 2} == touched and table.versions() == [1, 2]
    flush(more.limit(0), 2)
    assert {r.code: (r.clicks, r.last_accessed_at) for r in table.read().collect()} == first


def test_a_row_cannot_leave_its_shards(spark):
    table = VersionedLinks(spark, scratch_path(spark, f"versions-stray-{uuid.uuid4().hex}"), 4, LINK_SCHEMA)
    table.create(links(spark))
    try:
        table.commit(1, {0}, lambda rows: rows.withColumn("code", F.concat("code", F.lit("y"))))
        raise AssertionError("a stray row was written")
    except Exception as e:  # noqa: BLE001
        assert "not a touched shard" in str(e)
    assert table.versions() == [0] and table.read().count() == 40


def test_window_audit_finds_wrong_decisions(spark):
    rows = [("a", t, i) for i, t in enumerate([0, 0, 1, 5, 9, 10, 11, 30])]
    df = spark.createDataFrame(rows, "k string, ts bigint, tie bigint")
    good = S.sliding_window_limit(df, "k", "ts", "tie", 2, 10)
    seen = {r.tie: (r.allowed, r.inside) for r in S.audit_windows(good, ["k"], "ts", "tie", 10).collect()}
    assert seen == {0: (True, 0), 1: (True, 1), 2: (False, 2), 3: (False, 2), 4: (False, 2), 5: (True, 0), 6: (True, 1), 7: (True, 0)}
    wrong = good.withColumn("allowed", F.col("tie") != 5)
    inside = {r.tie: r.inside for r in S.audit_windows(wrong, ["k"], "ts", "tie", 10).collect()}
    assert inside[2] == 2 and inside[3] == 3 and inside[4] == 4 and inside[5] == 3


def test_quantiles_by_selection(spark):
    values = [("a", float(x % 97) ** 3, 1) for x in range(1000)] + [("b", 5.0, 1)] * 30 + [("c", 1e9, 1), ("c", 1.0, 1), ("c", None, 1)]
    values += [("d", 1e-9 * x, 1) for x in range(50)] + [("d", 1e12, 1), ("e", None, 1)]
    df = spark.createDataFrame(values, "g string, v double, tie int")
    qs = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in M.exact_quantiles(df, "g", "v", qs).collect()}
    for g in "abcd":
        own = sorted(v for k, v, _ in values if k == g and v is not None)
        assert got[g].n == len(own) and got[g].max == own[-1]
        for name, q in qs.items():
            assert got[g][name] == own[max(1, math.ceil(q * len(own))) - 1]
    assert "e" not in got


def test_shard_topk_reads_once(spark):
    df = links(spark)
    top = P.shard_topk(df, 4, 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "WindowGroupLimit" in plan
    assert [r.id for r in top.collect()] == [r.id for r in P.list_page(df, 5).collect()]


def test_link_totals_after_commit(spark):
    table = VersionedLinks(spark, scratch_path(spark, f"versions-none-{uuid.uuid4().hex}"), 2, LINK_SCHEMA)
    table.create(links(spark, 0))
    assert table.read().count() == 0 and table.manifest() == []
    version, report = reap(table, 1)
    assert version == 1 and report.count() == 0
    assert L.link_totals(table.read(), 2).first().links == 0

"""Cache reports from attributed reads, staging in one pass, static sides read a fixed number of times, draws by sorting."""

import datetime
import math
import random
import uuid

from pyspark.sql import functions as F

from linklens.operators import workload as W
from linklens.plans import catalog, q_seq, q_stream
from linklens.plans import views as V
from linklens.session import scratch_path
from linklens.streaming import jobs as J

catalog.load_all()


def events(spark, rows):
    """A folder with ``events`` rows (event_id, second, user_id, event_type, value, key) of the driver's schema."""
    folder = scratch_path(spark, f"events-{uuid.uuid4().hex}")
    start = datetime.datetime(2024, 1, 2)
    full = [(e, None if s is None else start + datetime.timedelta(seconds=s), u, t, v, f'{{"k": {k}}}') for e, s, u, t, v, k in rows]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(full, schema).write.parquet(f"{folder}/events.parquet")
    return folder


def test_cache_reports_rest_on_the_attribution(spark):
    # even ids keep the key; instance = event_id % 3; latency says nothing about the tier
    sf = events(spark, [(0, 0, 1, "click", 500.0, 1), (6, 1, 1, "click", 500.0, 1), (2, 2, 1, "click", 1.0, 1),
                        (12, 3, 1, "click", 1.0, 9), (4, 4, 1, "view", 1.0, 2)])
    tiers = {r.event_id: r.tier for r in q_seq.q_tier_attribution(spark, sf).collect()}
    assert tiers == {0: "l3", 6: "l1", 2: "l2"}  # key 9 has no link
    got = catalog.QUERIES["cache_effectiveness"](spark, sf).first().asDict()
    assert got == {"requests": 3, "lookups": 1, "effectiveness": 66.7}
    ratio = {r.cache_tier: (r.hits, r.misses, r.hit_pct) for r in catalog.QUERIES["tier_hit_ratio"](spark, sf).collect()}
    assert ratio == {"l1": (1, 2, 33.3), "l2": (1, 1, 50.0)}
    hit = {r.target: r.actual for r in catalog.QUERIES["slo_report"](spark, sf).collect()}
    assert hit["hit_pct"] == 66.7


def test_tiers_that_no_read_reached_are_reported(spark):
    sf = events(spark, [(4, 4, 1, "view", 1.0, 2)])
    rows = catalog.QUERIES["tier_hit_ratio"](spark, sf).collect()
    assert sorted(tuple(r) for r in rows) == [("l1", 0, 0, 0.0), ("l2", 0, 0, 0.0)]


def test_rows_without_time_or_key_do_not_stop_the_attribution(spark):
    sf = events(spark, [(0, 0, 1, "click", 1.0, 1), (6, 1, 1, "click", 1.0, 1), (12, None, 1, "click", 1.0, 1),
                        (18, None, 1, "purchase", 1.0, 1), (24, 2, 1, "signup", 1.0, "null"), (30, 3, 1, "click", 1.0, "null")])
    assert {r.event_id: r.tier for r in q_seq.q_tier_attribution(spark, sf).collect()} == {0: "l3", 6: "l1", 12: "l3"}
    ratio = {r.cache_tier: (r.hits, r.misses) for r in catalog.QUERIES["tier_hit_ratio"](spark, sf).collect()}
    assert ratio == {"l1": (1, 2), "l2": (0, 2)}


def test_staging_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for x in rows:
            seen.add(1)
            yield x

    n = 60
    df = spark.createDataFrame(spark.sparkContext.parallelize([(i * J.CHUNK_MS // 10, i) for i in range(n)], 4).mapPartitions(count),
                               "ts_ms bigint, tie bigint")
    path = J.stage_source(df, "ts_ms", "once")
    assert seen.value == n
    back = spark.read.parquet(path)
    assert back.columns == df.columns and sorted(r.tie for r in back.collect()) == list(range(n))
    files = back.select(F.input_file_name().alias("f"), F.expr(f"ts_ms div {J.CHUNK_MS}").alias("c")).distinct()
    assert files.count() == 6 and files.select("f").distinct().count() == 6  # a file is of one chunk


def test_many_files_make_few_micro_batches(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK_MS", 1000)
    df = spark.createDataFrame([(i * 500, i) for i in range(40)], "ts_ms bigint, tie bigint")
    path = J.stage_source(df, "ts_ms", "few", chunk_ms=1000)
    take = J.files_per_trigger(spark, path, 8)
    assert take == 3
    out = J.run_batches(J.click_source(spark, path, df.schema, take), "few", "append")
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 7 and sorted(r.tie for r in got.collect()) == list(range(40))


def test_static_side_is_not_computed_in_every_batch(spark, monkeypatch):
    rows = [(i, i * 86_400, i % 5, "click", 1.0, i % 20) for i in range(28)]
    sf = events(spark, rows)
    seen = spark.sparkContext.accumulator(0)
    links = [(r.id, r.code, r.url, r.created_at, r.expires_at, r.clicks, r.last_accessed_at) for r in V.request_links(spark, sf).collect()]
    schema = V.request_links(spark, sf).schema

    def counted(spark, sf):
        def count(part):
            for x in part:
                seen.add(1)
                yield x
        return spark.createDataFrame(spark.sparkContext.parallelize(links, 2).mapPartitions(count), schema)

    want = sorted(tuple(r) for r in catalog.QUERIES["resolve_requests"](spark, sf).fillna("").collect())
    monkeypatch.setattr(V, "request_links", counted)
    got = sorted(tuple(r) for r in q_stream.q_stream_resolve(spark, sf).fillna("").collect())
    assert got == want and len(got) == 28
    assert seen.value == len(links)


def test_draws_are_the_smallest_rank_at_or_above(spark):
    rng = random.Random(5)
    # crowded at the top, with equal points and a last point below 1
    points = sorted([0.1, 0.5, 0.5, *(1 - 2.0 ** -k for k in range(2, 40)), *(0.999 + i * 1e-7 for i in range(300))])
    points = [p for p in points if p < 0.9999999]
    us = [0.0, 0.1, 0.5, points[-1], 0.99999999, *points[::7], *(rng.random() for _ in range(300)), *(0.999 + rng.random() * 3e-5 for _ in range(300))]
    cdf = spark.createDataFrame([(i + 1, p) for i, p in enumerate(points)], "rank bigint, cdf double")
    draws = spark.createDataFrame([*enumerate(us), *enumerate(us), (-1, None)], "event_id bigint, u double")
    got = sorted((r.event_id, r.rank, r.cdf) for r in W.zipf_sample(draws, cdf).collect())
    want = []
    for i, u in enumerate(us):
        rank = next((k + 1 for k, p in enumerate(points) if p >= u), None)
        want += [(i, rank, points[rank - 1])] * 2 if rank else []
    assert got == sorted(want)


def test_draws_do_not_meet_intervals_in_pairs(spark):
    """With all points in one of the former 1,024 buckets: no join holds draws against points."""
    n = 20_000
    cdf = spark.range(1, n + 1).select(F.col("id").alias("rank"), (0.9995 + F.col("id") / (n * 2100.0)).alias("cdf"))
    draws = spark.range(n).select(F.col("id").alias("event_id"), (0.9995 + F.col("id") / (n * 2100.0)).alias("u"))
    out = W.zipf_sample(draws, cdf)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "_pid" in plan[plan.index("Join"):].splitlines()[0]
    rows = out.select("event_id", "rank").collect()
    assert len(rows) == n and all(r.rank == max(1, r.event_id) for r in rows)
    assert math.isclose(out.agg(F.max("cdf")).first()[0], 0.9995 + (n - 1) / (n * 2100.0))

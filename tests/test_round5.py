"""The online sliding limiter: state and calls per bucket of keys, rows of a key in time order however files are cut."""

import datetime
import random
import uuid

import pandas as pd
from pyspark.sql import functions as F

from linklens.operators import sequential as S
from linklens.plans import catalog, q_seq
from linklens.plans import views as V
from linklens.session import scratch_path
from linklens.streaming import jobs as J

catalog.load_all()

SCHEMA = "event_id bigint, client bigint, ts_ms bigint, tie bigint"
BIG = 1 << 60  # would not survive as a float


def events(spark, rows):
    """A folder with ``events`` rows (event_id, second, user_id, event_type, value, key) of the driver's schema."""
    folder = scratch_path(spark, f"events-{uuid.uuid4().hex}")
    start = datetime.datetime(2024, 1, 2)
    full = [(e, start + datetime.timedelta(seconds=s), u, t, v, f'{{"k": {k}}}') for e, s, u, t, v, k in rows]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(full, schema).write.parquet(f"{folder}/events.parquet")
    return folder


def decided(batches, limit, window):
    """(event_id, allowed, remaining, reset_at, retry_after_ms) of each row of the micro-batches, row by row."""
    logs, out = {}, []
    for rows in batches:
        for ev, key, t, tie in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[3] is None, r[3] or 0)):
            log, last = logs.get(key, ([], None))
            if t is None:
                logs[key] = [], None
                out.append((ev, limit > 0, max(0, limit - 1), None, 0 if limit else 1))
                continue
            t = t if last is None else max(t, last)
            log = [x for x in log if x > t - window]
            reset = (log[0] if log else t) + window
            if len(log) >= limit:
                out.append((ev, False, 0, reset, max(1, reset - t)))
            else:
                out.append((ev, True, limit - len(log) - 1, reset, 0))
                log = [*log, t]
            logs[key] = log, t
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_a_chunk_of_several_files_is_decided_in_time_order(spark, monkeypatch):
    rng = random.Random(3)
    # one chunk; a client with most rows, and the others with a few
    rows = [(i, rng.randrange(300_000), 0 if rng.random() < 0.6 else rng.randrange(1, 9), "click", 1.0, i % 7) for i in range(600)]
    sf = events(spark, rows)
    monkeypatch.setattr(J, "FILE_ROWS", 40)
    monkeypatch.setattr(J, "MAX_BATCHES", 100)
    want = S.sliding_window_limit(V.requests(spark, sf), "client", "ts_ms", "tie", q_seq.SLIDE_LIMIT, q_seq.SLIDE_WINDOW_MS)
    got = catalog.QUERIES["stream_sliding_limit"](spark, sf)
    assert ordered(got.collect()) == ordered(want.select(*got.columns).collect()) and got.count() == 600


def test_files_by_key_are_in_order_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(J, "FILE_ROWS", 40)
    df = spark.createDataFrame([(i, 0 if i % 3 else i % 10, (i * 37) % 500, i) for i in range(500)], SCHEMA).repartition(4)
    path = J.stage_source(df, "ts_ms", "by", by=F.col("client"), order=("ts_ms", "tie"))
    found = [(r.f, r.client, r.ts_ms, r.tie) for r in spark.read.parquet(path).withColumn("f", F.input_file_name()).collect()]
    assert sorted(r[3] for r in found) == list(range(500))
    files = {}
    for f, client, ts, tie in found:
        files.setdefault(f, []).append((client, ts, tie))
    assert len(files) > 4 and max(map(len, files.values())) <= 40
    spans = {}
    for f, rows in files.items():
        for client in {r[0] for r in rows}:
            mine = [r[1:] for r in rows if r[0] == client]
            spans.setdefault(client, []).append((min(mine), max(mine), f))
    assert len(spans[0]) > 1
    for parts in spans.values():
        parts.sort()
        assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(parts, parts[1:]))


def test_clients_share_rows_of_state(spark, monkeypatch):
    monkeypatch.setattr(J, "LIMIT_BUCKETS", 4, raising=False)
    rng = random.Random(4)
    batches, n = [], 0
    for _ in range(3):  # times overlap: rows come late
        rows = []
        for _ in range(300):
            rows.append((BIG + n, rng.choice([None, *range(60)]), rng.choice([None, *range(0, 9000, 10)]), BIG + rng.randrange(5)))
            n += 1
        batches.append([(None if i % 50 == 0 else r[0], *r[1:3], None if i % 40 == 7 else r[3]) for i, r in enumerate(rows)])
    # decisions of equal times and ties would depend on the order of arrival
    batches = [list({(r[1], r[2], r[3]): r for r in rows}.values()) for rows in batches]
    for limit in (2, 0):
        path, name = scratch_path(spark, f"buckets-{uuid.uuid4().hex}"), f"b{uuid.uuid4().hex}"
        for rows in batches:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        stream = J.click_source(spark, path, spark.read.parquet(path).schema)
        q = (J.stream_sliding_limit(stream, "client", limit, 400).writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", scratch_path(spark, name)).trigger(availableNow=True).start())
        q.awaitTermination()
        assert ordered(spark.table(name).collect()) == ordered(decided(batches, limit, 400))
        assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) <= 4


class Kept:
    """State of one bucket, by a clock that the test sets."""

    def __init__(self):
        self.value, self.now, self.timeout, self.hasTimedOut = None, 0, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.timeout = self.now + ms


def call(step, state, now, rows):
    state.now, state.hasTimedOut, state.timeout = now, rows is None, None
    frames = [pd.DataFrame([(0, f"={k}", e, t, e, 0) for e, k, t in part], columns=["_bucket", "_key", "_id", "_ts", "_tie", "_gaps"])
              for part in ([rows[::2], rows[1::2]] if rows and len(rows) > 1 else [rows or []])]
    return [r for pdf in step((0,), iter(frames), state) for r in pdf.itertuples(index=False, name=None)]


def test_a_key_goes_after_its_own_idle_time():
    step, state = J.sliding_step(1, 1000, idle_ms=100), Kept()
    assert [r[1] for r in call(step, state, 0, [(1, "a", 10), (2, "b", 10)])] == [True, True]
    assert state.timeout == 100
    assert [r[1] for r in call(step, state, 90, [(3, "a", 20)])] == [False]
    assert state.timeout == 100  # b's; at that time it is not over yet
    assert call(step, state, 101, None) == [] and state.timeout == 190
    assert [r[1] for r in call(step, state, 102, [(4, "b", 30)])] == [True]  # forgotten
    assert [r[1] for r in call(step, state, 195, [(5, "a", 40)])] == [False]  # came with the micro-batch
    assert call(step, state, 1000, None) == [] and not state.exists


def test_decisions_are_passed_on_in_blocks(monkeypatch):
    rng = random.Random(6)
    batches = [[(i, rng.randrange(4), rng.randrange(500), i) for i in range(a, a + 40)] for a in (0, 40)]
    monkeypatch.setattr(J, "BLOCK_ROWS", 7, raising=False)
    step, state, got = J.sliding_step(2, 60, None), Kept(), []
    for rows in batches:
        got += call(step, state, 0, [r[:3] for r in rows])
    assert ordered(got) == ordered(decided(batches, 2, 60))

"""Episodes that span many chunks: renewal chains and limiters against row-by-row walks."""

import math
import random

import numpy as np
import pytest

from linklens.operators import limiters, renewal
from linklens.operators import sequential as S

BIG = 9007199254740995  # does not survive a double


def events(seed, n=600):
    """(key, ts, tie): a hot key, a bursty one, a null one; equal times occur."""
    rng, rows, now = random.Random(seed), [], {"hot": 0, "bursty": 0, None: 0}
    for i in range(n):
        key = rng.choice(["hot", "hot", "bursty", None])
        step = rng.choice([0, 1, 2, 5]) if key == "hot" else rng.choice([0, 1, 3, 400]) if key == "bursty" else rng.choice([1, 40])
        now[key] += step
        rows.append((key, now[key], i))
    return rows


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def frame(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "key string, ts bigint, tie bigint" + extra)
    return df.selectExpr("*", f"IF(tie % 2 = 0, {BIG}, NULL) AS passed", "'x' AS allowed_by", "1 AS bp")


@pytest.mark.parametrize("limit, window, rounds", [(3, 20, 4), (2, 7, 0), (40, 30, 1), (0, 10, 1)])
def test_sliding_in_chunks(spark, monkeypatch, limit, window, rounds):
    monkeypatch.setattr(limiters, "ROUNDS", rounds)
    rows, want = events(limit), {}
    for own in by_key(rows).values():
        log = []
        for _, t, tie in own:
            log = [x for x in log if x > t - window]
            used = len(log)
            if used < limit:
                want[tie] = (True, limit, limit - used - 1, (log[0] if log else t) + window, 0)
                log.append(t)
            else:
                reset = (log[0] if log else t) + window
                want[tie] = (False, limit, 0, reset, max(1, reset - t))
    out = S.sliding_window_limit(frame(spark, rows), "key", "ts", "tie", limit, window, bucket_ms=50, chunk_windows=2).collect()
    assert {r.tie: (r.allowed, r.limit, r.remaining, r.reset_at, r.retry_after_ms) for r in out} == want
    assert all(r.passed == (BIG if r.tie % 2 == 0 else None) for r in out) and len(out) == len(rows)


@pytest.mark.parametrize("cap, refill, cost, rounds", [(3.0, 100.0, 1, 4), (2.5, 7.3, 1.5, 0), (1.0, 333.3, 2, 1)])
def test_bucket_in_chunks(spark, monkeypatch, cap, refill, cost, rounds):
    monkeypatch.setattr(limiters, "ROUNDS", rounds)
    monkeypatch.setattr(limiters, "FIRST_RUN", 2)
    rows, want = events(int(cap * 10)), {}
    for own in by_key(rows).values():
        tokens, before = cap, own[0][1]
        for _, t, tie in own:
            tokens = min(cap, tokens + ((t - before) / 1000.0) * refill)
            ok, before = tokens >= cost, t
            tokens = tokens - cost if ok else tokens
            retry = 0 if ok else max(1, math.ceil(((cost - tokens) / refill) * 1000.0))
            want[tie] = (ok, int(cap), math.floor(tokens), t + math.ceil(((cap - tokens) / refill) * 1000.0), retry)
    out = S.token_bucket_limit(frame(spark, rows), "key", "ts", "tie", cap, refill, cost, bucket_ms=50, chunk_windows=1).collect()
    assert {r.tie: (r.allowed, r.limit, r.remaining, r.reset_at, r.retry_after_ms) for r in out} == want


def brute_ttl(rows, ttl):
    want = {}
    for own in by_key([(k, t, i, kind, cap) for k, t, i, kind, cap in rows]).values():
        fill, until = None, None
        for _, t, tie, kind, cap in own:
            life = ttl if cap is None else min(ttl, cap)
            if kind == "clear":
                fill = until = None
                want[tie] = (None, None)
                continue
            if kind == "read" and until is not None and until > t:
                want[tie] = (False, fill)
                continue
            want[tie] = (True, t) if kind == "read" else (None, None)
            fill, until = (t, t + life) if life > 0 else (None, None)
    return want


@pytest.mark.parametrize("ttl, chunk, block", [(10, 15, 2), (3, 40, 256), (25, 4, 3)])
def test_ttl_in_chunks(spark, monkeypatch, ttl, chunk, block):
    monkeypatch.setattr(renewal, "BLOCK", block)
    rng = random.Random(ttl)
    rows = [(k, t, i, rng.choices(["read", "fill", "clear"], [30, 1, 1])[0], rng.choice([None, None, None, 0, 4, 99]))
            for k, t, i in events(ttl)]
    df = frame(spark, rows, ", kind string, cap bigint")
    out = S.ttl_first_touch(df, "key", "ts", "tie", ttl, kind="kind", ttl_cap="cap", bucket_ms=30, chunk_ms=chunk)
    assert out.columns == [*df.columns, "is_fill", "leader_ts"]
    got = out.collect()
    assert {r.tie: (r.is_fill, r.leader_ts) for r in got} == brute_ttl(rows, ttl)
    assert all(r.passed == (BIG if r.tie % 2 == 0 else None) for r in got)


def test_inflight_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(renewal, "BLOCK", 2)
    rng = random.Random(5)
    rows, want = [(k, t, i, t + rng.choice([0, 1, 6, 30])) for k, t, i in events(9)], {}
    for own in by_key(rows).values():
        start, end = None, None
        for _, t, tie, e in own:
            joins = end is not None and t < end
            start, end = (start, end) if joins else (t, e)
            want[tie] = (not joins, start)
    out = S.inflight_collapse(frame(spark, rows, ", e bigint"), "key", "ts", "e", "tie", bucket_ms=30, chunk_ms=20).collect()
    assert {r.tie: (r.executed, r.leader_start) for r in out} == want


def test_step_functions():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ts = np.sort(rng.integers(0, 40, rng.integers(1, 30)))
        expiry = ts + rng.integers(-1, 12, len(ts))
        cut = rng.integers(0, len(ts) + 1)
        parts = [(ts[a:b], expiry[a:b]) for a, b in ((0, cut), (cut, len(ts))) if b > a]
        functions = [renewal.step_function(*p) for p in parts]
        whole = functions[0] if len(functions) == 1 else renewal.composed(*functions)
        for entry in range(-2, 55):
            state = (entry, -7)
            for t, e in zip(ts.tolist(), expiry.tolist(), strict=True):
                if t >= state[0]:
                    state = (e, t)
            if cut in (0, len(ts)) or ts[cut - 1] < ts[cut]:
                assert renewal.applied(whole, (entry, -7)) == state

"""Limiters over long episodes: speculate, verify, repair.

A limiter's decisions depend on all earlier ones of the episode, but its state
forgets: a log that has run empty, a bucket that is full again, are the same whatever came
before. So an episode of several chunks (``CHUNK_WINDOWS`` windows each) is walked from an
assumed state in every chunk at once; then each chunk is walked from the state in which its
predecessor ended, and again wherever that state has changed meanwhile, until nothing
changes. A chunk whose entry equals its predecessor's exit is right if the predecessor is.
Where states do not meet within ``ROUNDS`` rounds (a key that is over its limit all the time),
the rest of the episode is walked in one stream, chunk after chunk.

Walks are by admitted rows: the rejections between two of them are filled in at once.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linklens.operators.chunks import dealt, extended, key_text, numbers, runs, staged

#: Windows (or times to fill a bucket) in a chunk: long enough for states to meet.
CHUNK_WINDOWS = 16
#: Rounds of repair before the rest of an episode is walked in one stream.
ROUNDS = 4
#: Rows of a rejected run that are tried at first.
FIRST_RUN = 64
OUTPUTS = {"allowed": pa.bool_(), "limit": pa.int64(), "remaining": pa.int64(), "reset_at": pa.int64(),
           "retry_after_ms": pa.int64()}


class Sliding:
    """Log of admitted times; state: the times that still count, as 64-bit integers."""

    params = ("_lim", "_win")

    def walk(self, state: bytes | None, ts: np.ndarray, params: dict[str, np.ndarray]) -> tuple[bytes, list[np.ndarray]]:
        """(state after the rows, columns of ``OUTPUTS``) of rows in order."""
        n, times = len(ts), ts.tolist()
        allowed, remaining = np.zeros(n, bool), np.zeros(n, np.int64)
        reset, retry = np.empty(n, np.int64), np.zeros(n, np.int64)
        limits, windows = params["_lim"], params["_win"]
        log: deque[int] = deque(np.frombuffer(state or b"", np.int64).tolist())
        cuts = np.flatnonzero((limits[1:] != limits[:-1]) | (windows[1:] != windows[:-1])) + 1
        i, window = 0, 0
        for stop in [*cuts.tolist(), n]:  # parameters are the same up to each
            limit, window = int(limits[i]), int(windows[i])
            while i < stop:
                now = times[i]
                while log and log[0] <= now - window:
                    log.popleft()
                used = len(log)
                if used < limit:
                    allowed[i], remaining[i] = True, limit - used - 1
                    reset[i] = (log[0] if used else now) + window
                    log.append(now)
                    i += 1
                    continue
                # nothing is admitted before the oldest entry leaves; with a limit of 0 there may be none
                until = bisect_left(times, log[0] + window, i + 1, stop) if log else stop
                reset[i:until] = log[0] + window if log else ts[i:until] + window
                retry[i:until] = np.maximum(1, reset[i:until] - ts[i:until])
                i = until
        while log and log[0] <= times[-1] - window:
            log.popleft()
        return np.array(log, np.int64).tobytes(), [allowed, limits, remaining, reset, retry]


class Bucket:
    """Tokens as a double and the time of the last row, refilled and stored at every row."""

    params = ("_cap", "_ref", "_cost")

    def walk(self, state: bytes | None, ts: np.ndarray, params: dict[str, np.ndarray]) -> tuple[bytes, list[np.ndarray]]:
        """(state after the rows, columns of ``OUTPUTS``) of rows in order."""
        n = len(ts)
        cap, refill, cost = (params[c] for c in self.params)
        tokens, before = struct.unpack("<dq", state) if state else (float(cap[0]), int(ts[0]))
        gained = (np.maximum(ts - np.r_[before, ts[:-1]], 0) / 1000.0) * refill
        left, allowed = np.empty(n), np.zeros(n, bool)
        caps, costs, gains = cap.tolist(), cost.tolist(), gained.tolist()
        # a run of rejections adds gains only; sums in order, as row after row would
        steady = bool((cap == cap[0]).all() and (cost == cost[0]).all() and cost[0] <= cap[0])
        i, width = 0, FIRST_RUN
        while i < n:
            tokens = min(caps[i], tokens + gains[i])
            if tokens >= costs[i]:
                tokens -= costs[i]
                allowed[i] = True
            left[i] = tokens
            i += 1
            if allowed[i - 1] or not steady:
                continue
            width = FIRST_RUN
            while i < n:
                sums = np.add.accumulate(np.r_[tokens, gained[i:i + width]])[1:]
                enough = np.flatnonzero(sums >= costs[0])
                stop = int(enough[0]) if len(enough) else len(sums)
                left[i:i + stop] = sums[:stop]
                if stop:
                    tokens = float(sums[stop - 1])
                i += stop
                if len(enough):
                    break
                width *= 2
        reset = ts + np.ceil(((cap - left) / refill) * 1000.0).astype(np.int64)
        short = np.where(allowed, 0.0, np.ceil(((cost - left) / refill) * 1000.0)).astype(np.int64)
        retry = np.where(allowed, 0, np.maximum(1, short))
        return (struct.pack("<dq", tokens, int(ts[-1])),
                [allowed, np.floor(cap).astype(np.int64), np.floor(left).astype(np.int64), reset, retry])


_CHUNK = ["_k", "_ep", "_b"]


def _exits(rows: DataFrame, rule: Sliding | Bucket, whole: bool = False) -> DataFrame:
    """(_k, _ep, _b, used, state): how every chunk of ``rows`` ends if it is entered with ``_in``.

    With ``whole`` the chunks of an episode are one walk from the entry of the first.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, state = None, None, None

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([last[0]], pa.string()), pa.array([last[1]], pa.int64()), pa.array([last[2]], pa.int64()),
                 pa.array([used], pa.binary()), pa.array([state], pa.binary())], names=[*_CHUNK, "used", "state"])

        for batch in batches:
            ts, entry = numbers(batch, "_t"), batch.column(batch.schema.get_field_index("_in"))
            params = {c: numbers(batch, c) for c in rule.params}
            for a, b, goes_on, key in runs(batch, _CHUNK, last):
                if not goes_on:
                    if last:
                        yield closed()
                    used = state if whole and last and last[:2] == key[:2] else entry[a].as_py()
                    last, state = key, used
                state, _ = rule.walk(state, ts[a:b], {c: p[a:b] for c, p in params.items()})
        if last:
            yield closed()

    cols = [*_CHUNK, "_t", "_tie", "_in", *rule.params]
    sorted_rows = dealt(rows.select(*cols), _CHUNK[:2], ["_b", "_t", "_tie"]) if whole else dealt(rows.select(*cols), _CHUNK, ["_t", "_tie"])
    return sorted_rows.mapInArrow(walk, "_k string, _ep bigint, _b bigint, used binary, state binary")


def _stale(chunks: DataFrame) -> DataFrame:
    """(_k, _ep, _b, _in): the chunks that were not entered with the state in which their predecessor ends."""
    before = F.lag("state").over(Window.partitionBy("_k", "_ep").orderBy("_b"))
    return chunks.withColumn("_in", before).filter(~F.col("used").eqNullSafe(F.col("_in"))).select(*_CHUNK, "_in")


def chunk_states(rows: DataFrame, rule: Sliding | Bucket) -> DataFrame | None:
    """(_k, _ep, _b, _in): the state in which each chunk of an episode of several is entered; None without such episodes."""
    if rows.filter("_b > 0").isEmpty():
        return None
    several = rows.filter("_b > 0").select("_k", "_ep").distinct()
    hot = staged(rows.select(*_CHUNK, "_t", "_tie", *rule.params).join(several, ["_k", "_ep"], "left_semi"), "limit-rows")
    chunks = staged(_exits(hot.withColumn("_in", F.lit(None).cast("binary")), rule), "limit-chunks")
    for _ in range(ROUNDS):
        stale = staged(_stale(chunks), "limit-stale")
        if stale.isEmpty():
            break
        again = _exits(hot.join(stale, _CHUNK), rule)
        chunks = staged(chunks.join(stale, _CHUNK, "left_anti").unionByName(again), "limit-chunks")
    else:
        stale = staged(_stale(chunks), "limit-stale")
        firsts = stale.groupBy("_k", "_ep").agg(F.min(F.struct("_b", "_in")).alias("first"))
        rest = hot.join(firsts, ["_k", "_ep"]).filter(F.col("_b") >= F.col("first._b")).withColumn("_in", F.col("first._in"))
        kept = chunks.join(firsts, ["_k", "_ep"], "left").filter(F.col("first").isNull() | (F.col("_b") < F.col("first._b")))
        again = _exits(rest, rule, whole=True)
        chunks = staged(kept.select(*again.columns).unionByName(again), "limit-chunks")
    return chunks.select(*_CHUNK, F.col("used").alias("_in"))


def decide(d: DataFrame, names: list[str], key: str, ts: str, tie: str, rule: Sliding | Bucket, params: list[str],
           window: Column, chunk_windows: int) -> DataFrame:
    """The columns ``names`` of ``d`` and the limiter's decision on every row; ``d`` has ``_ep`` and the rule's ``params``."""
    width = F.greatest(window * chunk_windows, F.lit(1))
    d = (d.withColumn("_k", key_text(key)).withColumn("_t", F.col(ts).cast("long")).withColumn("_tie", F.col(tie))
         .withColumn("_b", F.floor((F.col("_t") - F.col("_ep")) / width).cast("bigint")))
    d = staged(d.select(*names, *_CHUNK, "_t", "_tie", *params), "limit-rows")  # read by every step from here on
    states = chunk_states(d, rule)
    d = d.withColumn("_in", F.lit(None).cast("binary")) if states is None else d.join(states, _CHUNK, "left")
    own = [*_CHUNK, "_t", "_tie", "_in", *params]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            times, entry = numbers(batch, "_t"), batch.column(batch.schema.get_field_index("_in"))
            values, found = {c: numbers(batch, c) for c in params}, []
            for a, b, goes_on, chunk in runs(batch, _CHUNK, last):
                if not goes_on:
                    last, state = chunk, entry[a].as_py()
                state, columns = rule.walk(state, times[a:b], {c: v[a:b] for c, v in values.items()})
                found.append(columns)
            out = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[]] * len(OUTPUTS)
            yield extended(batch, set(own), {name: pa.array(c, kind) for (name, kind), c in zip(OUTPUTS.items(), out, strict=True)})

    kept = dealt(d, _CHUNK, ["_t", "_tie"])
    schema = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in names)
    fields = "allowed boolean, limit bigint, remaining bigint, reset_at bigint, retry_after_ms bigint"
    return kept.mapInArrow(apply, f"{schema}, {fields}")

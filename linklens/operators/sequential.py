"""Sequential per-key operators: limiters, TTL reuse, in-flight collapse.

These decisions depend on earlier decisions of the same key, so they are not
window counts. The scaffold keeps them distributed:

1. **Running aggregates without a per-key window.** A key's rows are grouped by
   ``(key, time bucket)``; running max/sum are computed inside each bucket and
   the contribution of earlier buckets is carried through a small per-bucket
   aggregate (one row per non-empty bucket). A hot key is therefore spread over
   many buckets instead of one task.
2. **Episode split.** A new episode starts where the state is provably empty
   (sliding: gap >= window; bucket: refill of the gap >= capacity; TTL and
   in-flight: start >= every earlier expiry). Episodes are independent.
3. **Chunks.** An episode that never pauses is cut into chunks of time. TTL reuse and
   in-flight collapse compose the chunks' step functions (:mod:`renewal`); limiters
   walk chunks from assumed states, compare and repair (:mod:`limiters`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linklens.operators import limiters, renewal

DEFAULT_BUCKET_MS = 3_600_000
#: A chunk of a TTL or in-flight episode.
CHUNK_MS = 86_400_000


def _order(ts: str, tie: str):
    return [F.col(ts), F.col(tie)]


def running(df: DataFrame, key: str, ts: str, tie: str, values: dict[str, tuple[Column, str]],
            bucket_ms: int = DEFAULT_BUCKET_MS, inclusive: bool = False) -> DataFrame:
    """For each ``out: (value, how)`` the max/sum of the value over the key's earlier rows (or through the current one).

    Order is ``(ts, tie)``. Computed per ``(key, ts div bucket_ms)`` plus a
    carry from earlier buckets, so no task holds all rows of one key.
    """
    aggs = {out: F.max if how == "max" else F.sum for out, (_, how) in values.items()}
    d = df.withColumn("_rb", F.call_function("div", F.col(ts), F.lit(bucket_ms)))
    d = d.withColumns({f"_v{out}": value for out, (value, _) in values.items()})
    w_local = (Window.partitionBy(key, "_rb").orderBy(*_order(ts, tie))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1))
    per_bucket = d.groupBy(key, "_rb").agg(*[agg(f"_v{out}").alias(f"_b{out}") for out, agg in aggs.items()])
    d = d.withColumns({f"_l{out}": agg(f"_v{out}").over(w_local) for out, agg in aggs.items()})
    w_carry = Window.partitionBy(key).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select(F.col(key).alias("_ck"), F.col("_rb").alias("_cb"),
                                   *[agg(f"_b{out}").over(w_carry).alias(f"_c{out}") for out, agg in aggs.items()])
    # null keys are one key, as in the windows
    d = d.join(per_bucket, F.col(key).eqNullSafe(F.col("_ck")) & (F.col("_rb") == F.col("_cb")), "left")
    for out, (_, how) in values.items():
        local, carry = F.col(f"_l{out}"), F.col(f"_c{out}")
        d = d.withColumn(out, F.greatest(local, carry) if how == "max"
                         else F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    return d.drop("_ck", "_cb", "_rb", *[f"_{x}{out}" for out in values for x in "vlc"])


def running_prev(df: DataFrame, key: str, ts: str, tie: str, value: Column, how: str, out: str,
                 bucket_ms: int = DEFAULT_BUCKET_MS, inclusive: bool = False) -> DataFrame:
    """:func:`running` for one value."""
    return running(df, key, ts, tie, {out: (value, how)}, bucket_ms, inclusive)


def split_episodes(df: DataFrame, key: str, ts: str, tie: str, breaks, carry: Column | None = None,
                   bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """Add ``_ep``: the ts of the row that opened this row's episode.

    ``breaks(prev)`` gets the max of ``carry`` (default: ``ts``) over the
    key's earlier rows and returns true where a new episode starts; the first
    row of a key always starts one.
    """
    carry = F.col(ts) if carry is None else carry
    d = running_prev(df, key, ts, tie, carry, "max", "_prev", bucket_ms)
    d = d.withColumn("_start", F.when(F.col("_prev").isNull() | breaks(F.col("_prev")), F.col(ts)))
    d = running_prev(d, key, ts, tie, F.col("_start"), "max", "_ep", bucket_ms, inclusive=True)
    return d.drop("_prev", "_start")


LIMIT_FIELDS = [
    T.StructField("allowed", T.BooleanType()),
    T.StructField("limit", T.LongType()),
    T.StructField("remaining", T.LongType()),
    T.StructField("reset_at", T.LongType()),
    T.StructField("retry_after_ms", T.LongType()),
]


def _lit_or_col(v, name: str) -> Column:
    return F.col(v) if isinstance(v, str) else F.lit(v)


def sliding_window_limit(df: DataFrame, key: str, ts: str, tie: str, limit, window_ms,
                         bucket_ms: int = DEFAULT_BUCKET_MS, chunk_windows: int = limiters.CHUNK_WINDOWS) -> DataFrame:
    """Exact sliding-window log limiter; appends allowed/limit/remaining/reset_at/retry_after_ms.

    The log holds admitted timestamps only; entries with ``t <= now - window``
    are dropped; ``used >= limit`` rejects (not logged). ``limit`` and
    ``window_ms`` may be ints or column names (constant per key).
    """
    d = df.withColumn("_lim", _lit_or_col(limit, "limit").cast("long")) \
          .withColumn("_win", _lit_or_col(window_ms, "window").cast("long"))
    d = split_episodes(d, key, ts, tie, lambda prev: F.col(ts) - prev >= F.col("_win"), bucket_ms=bucket_ms)
    return limiters.decide(d, df.columns, key, ts, tie, limiters.Sliding(), ["_lim", "_win"], F.col("_win"), chunk_windows)


def token_bucket_limit(df: DataFrame, key: str, ts: str, tie: str, capacity, refill_per_s, cost=1,
                       bucket_ms: int = DEFAULT_BUCKET_MS, chunk_windows: int = limiters.CHUNK_WINDOWS) -> DataFrame:
    """Exact token bucket (lazy refill, float state, same operation order as the reference)."""
    d = (df.withColumn("_cap", _lit_or_col(capacity, "capacity").cast("double"))
         .withColumn("_ref", _lit_or_col(refill_per_s, "refill").cast("double"))
         .withColumn("_cost", _lit_or_col(cost, "cost").cast("double")))
    d = split_episodes(d, key, ts, tie,
                       lambda prev: ((F.col(ts) - prev) / 1000.0) * F.col("_ref") >= F.col("_cap"),
                       bucket_ms=bucket_ms)
    full = F.ceil(F.col("_cap") / F.col("_ref") * 1000.0).cast("long")
    return limiters.decide(d, df.columns, key, ts, tie, limiters.Bucket(), ["_cap", "_ref", "_cost"], full, chunk_windows)


def audit_windows(decided: DataFrame, keys: list[str], ts: str, tie: str, window_ms: int) -> DataFrame:
    """``decided`` (with ``allowed``) and inside: the key's admitted rows of the last ``window_ms`` before each row.

    Time is cut in buckets of one window. Every admitted row also stands in the next bucket,
    as its tail, so a bucket's rows find all they need in their own group
    and a hot key is spread over time; no group holds more than two windows.
    """
    bucket = F.call_function("div", F.col(ts), F.lit(window_ms))
    own = decided.withColumn("_bucket", bucket).withColumn("_tail", F.lit(False))
    tails = own.where("allowed").withColumn("_bucket", F.col("_bucket") + 1).withColumn("_tail", F.lit(True))
    rows = own.unionByName(tails)
    group, counted = [*keys, "_bucket"], F.col("allowed").cast("long")
    before = Window.partitionBy(*group).orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    left = Window.partitionBy(*group).orderBy(ts).rangeBetween(Window.unboundedPreceding, -window_ms)
    inside = F.coalesce(F.sum(counted).over(before), F.lit(0)) - F.coalesce(F.sum(counted).over(left), F.lit(0))
    return rows.withColumn("inside", inside).where(~F.col("_tail")).drop("_bucket", "_tail")


TTL_FIELDS = [T.StructField("is_fill", T.BooleanType()), T.StructField("leader_ts", T.LongType())]


def ttl_first_touch(df: DataFrame, key: str, ts: str, tie: str, ttl_ms, kind: str | None = None,
                    ttl_cap: str | None = None, bucket_ms: int = DEFAULT_BUCKET_MS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """First event of a key fills; later events hit until ``fill + ttl`` (not extended by hits).

    Optional ``kind`` column: ``read`` (default behaviour), ``fill`` (write-through:
    resets the entry at this time, not counted as a read) or ``clear`` (ends the
    entry at once). Optional ``ttl_cap`` column caps the TTL of a fill (e.g. the
    remaining life of the link). Output: ``is_fill``, ``leader_ts`` (null for
    non-read events).
    """
    ttl, own = _lit_or_col(ttl_ms, "ttl").cast("long"), F.col(kind) if kind else F.lit("read")
    life = F.least(ttl, F.col(ttl_cap).cast("long")) if ttl_cap else ttl  # a null cap is no cap
    holds = (own != "clear") & (life > 0)
    d = df.withColumn("_exp", F.when(holds, F.col(ts) + life).otherwise(F.lit(renewal.NEVER))).withColumn("_reset", own != "read")
    out = _chains(d, df.columns, key, ts, tie, bucket_ms, chunk_ms)
    read = F.col(kind) == "read" if kind else F.lit(True)
    return out.select(*df.columns, F.when(read, F.col("_lead")).alias("is_fill"),
                      F.when(read, F.col("_leader_ts")).alias("leader_ts"))


def _chains(d: DataFrame, names: list[str], key: str, ts: str, tie: str, bucket_ms: int, chunk_ms: int) -> DataFrame:
    """``names`` with _lead and _leader_ts, from _exp and _reset of every row."""
    d = d.withColumn("_ts", F.col(ts).cast("long")).withColumn("_tie", F.col(tie))
    d = running(d, key, "_ts", "_tie", {"_prev": (F.col("_exp"), "max")}, bucket_ms)
    d = d.withColumn("_start", F.col("_prev").isNull() | F.col("_reset") | (F.col("_ts") >= F.col("_prev")))
    d = running(d, key, "_ts", "_tie", {"_ep": (F.col("_start").cast("long"), "sum"),
                                        "_ep_ts": (F.when(F.col("_start"), F.col("_ts")), "max")}, bucket_ms, inclusive=True)
    return renewal.leaders(d, names, key, chunk_ms)


FLIGHT_FIELDS = [T.StructField("executed", T.BooleanType()), T.StructField("leader_start", T.LongType())]


def inflight_collapse(df: DataFrame, key: str, start: str, end: str, tie: str,
                      bucket_ms: int = DEFAULT_BUCKET_MS, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Single-flight: a call executes unless it starts before the running leader's end, then joins it."""
    d = df.withColumn("_exp", F.col(end).cast("long")).withColumn("_reset", F.lit(False))
    out = _chains(d, df.columns, key, start, tie, bucket_ms, chunk_ms)
    return out.select(*df.columns, F.col("_lead").alias("executed"), F.col("_leader_ts").alias("leader_start"))


def failure_episodes(df: DataFrame, dep: str, ts: str, tie: str, ok: str, threshold: int = 5,
                     bucket_ms: int = DEFAULT_BUCKET_MS) -> DataFrame:
    """Outages: runs of >= threshold consecutive failures per dependency (gaps and islands).

    island = running count of successes (through the row); a run's failures
    share an island. The outage opens at the threshold-th failure and closes
    at the first success after it (the first row of the next island). All of
    it is running sums (bucketed) and group-bys: no sequential Python.
    """
    okc = F.col(ok).cast("int")
    d = running_prev(df, dep, ts, tie, okc, "sum", "_island", bucket_ms, inclusive=True)
    d = running_prev(d, dep, ts, tie, 1 - okc, "sum", "_fails", bucket_ms, inclusive=True)
    fails = d.where(~F.col(ok))
    runs = fails.groupBy(dep, "_island").agg(
        F.count(F.lit(1)).alias("failures"),
        F.min("_fails").alias("_first_rank"),
        F.min(F.struct(ts, tie)).getField(ts).alias("first_failure_ms"),
        F.max(F.struct(ts, tie)).getField(ts).alias("last_failure_ms"))
    runs = runs.where(F.col("failures") >= threshold)
    opening = (fails.join(runs.select(dep, "_island", "_first_rank"), [dep, "_island"])
               .where(F.col("_fails") - F.col("_first_rank") + 1 == threshold)
               .select(dep, "_island", F.col(ts).alias("opened_ms")))
    closing = (d.where(F.col(ok)).groupBy(dep, "_island")
               .agg(F.min(ts).alias("closed_ms"))
               .select(dep, (F.col("_island") - 1).alias("_island"), "closed_ms"))
    out = runs.join(opening, [dep, "_island"]).join(closing, [dep, "_island"], "left")
    return out.select(dep, F.col("_island").alias("island"), "failures", "first_failure_ms", "opened_ms",
                      "closed_ms", (F.col("closed_ms") - F.col("opened_ms")).alias("duration_ms"))

"""Structured Streaming jobs.

Sources are file directories (any streaming source works the same way).
Sinks are ``foreachBatch`` writers that overwrite ``<out>/batch=<id>`` so a
replayed micro-batch after a failure rewrites the same folder instead of
appending twice (exactly-once with the checkpoint). Checkpoints live under the
cluster's ``spark.checkpoint.dir``.

No job drops rows: there is no watermark that could cut late ones off. Window counts are partial sums per
micro-batch that readers add up, so they keep no state; the limiters order rows inside a micro-batch, let time stand
still where a later micro-batch brings an earlier row, and may evict idle keys by the clock. Counting late clicks is our addition.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from linklens.operators import links as L
from linklens.operators.chunks import key_text
from linklens.operators.metrics import global_positions
from linklens.session import scratch_path
from linklens.sources.versions import VersionedLinks, shards_of

CHUNK_MS = 5 * 86_400_000
FILE_ROWS = 2_000_000
MAX_BATCHES = 8
MAX_FILES = 4  # of a limiter's trigger, whose rows of one key are held at once


def stage_source(df: DataFrame, ts_col: str, name: str, chunk_ms: int = CHUNK_MS, one_file: bool = False,
                 by: Column | None = None, order: tuple[str, ...] = ()) -> str:
    """Write ``df`` as a file-source directory, one write per time chunk in time order.

    With ``one_file`` a chunk is one file, so that a trigger of one file is one chunk.
    With ``by`` a chunk of several files has all rows of one value of ``by`` in one of them, or in several that one task
    writes one after the other in ``order``: such rows come in time order however the triggers cut the files.

    Each chunk becomes a later file set, so with ``maxFilesPerTrigger`` the
    stream sees micro-batches in event-time order (as a live feed would). ``df`` is computed once, into
    a folder for each chunk; a chunk's files are made from its folder, one for every ``FILE_ROWS`` rows.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-src-{uuid.uuid4().hex}")
    split = scratch_path(spark, f"{name}-chunks-{uuid.uuid4().hex}")
    df.withColumn("_chunk", F.call_function("div", F.col(ts_col), F.lit(chunk_ms))).write.partitionBy("_chunk").parquet(split)
    staged = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_chunk", T.LongType())])).parquet(split)
    # one row per chunk: bounded by the time span
    for c, n in staged.groupBy("_chunk").agg(F.count(F.lit(1))).orderBy("_chunk").collect():
        part = staged.where(F.col("_chunk") == F.lit(c)).select(*df.columns)
        files = 1 if one_file else max(1, -(-n // FILE_ROWS))
        if by is None or files == 1:
            part.coalesce(files).write.mode("append").parquet(path)
        else:  # a quarter more, as they come out unequal
            (part.repartition(-(-5 * n // (4 * FILE_ROWS)), by).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order])
             .write.option("maxRecordsPerFile", FILE_ROWS).mode("append").parquet(path))
    return path


def files_per_trigger(spark: SparkSession, path: str, batches: int = MAX_BATCHES) -> int:
    """Files a trigger takes so that all files at ``path`` make at most ``batches`` micro-batches.

    For flushes that read or rewrite a whole table: that is then done a fixed number of times, however long the feed.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    files = sum(1 for f in listed if not str(f.getPath().getName()).startswith(("_", ".")))
    return max(1, -(-files // batches))


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, into the shared folder: the static side of a stream is read again by every micro-batch."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def click_source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """Unbounded click feed over a directory of parquet files."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def run_batches(stream: DataFrame, name: str, mode: str, fn=None) -> str:
    """Run ``stream`` to completion (availableNow); each micro-batch -> ``<out>/batch=<id>``.

    ``fn(batch_df, batch_id)`` may transform the batch before it is written.
    Returns the output folder (read it with ``spark.read.parquet``).
    """
    spark = stream.sparkSession
    out = scratch_path(spark, f"{name}-out-{uuid.uuid4().hex}")
    ckpt = scratch_path(spark, f"{name}-ckpt-{uuid.uuid4().hex}")

    def sink(batch: DataFrame, batch_id: int) -> None:
        b = fn(batch, batch_id) if fn else batch
        b.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def read_batches(spark: SparkSession, out: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read
    return reader.parquet(out)


def latest_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """For update-mode output: the row of the last batch that touched each key."""
    cols = [c for c in df.columns if c not in keys and c != "batch"]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch")).alias("_r"))
    return agg.select(*keys, "_r.*")


def window_start(window_ms: int, ts_col: str = "ts_ms"):
    """Start of the window a time falls in, in ms."""
    return F.col(ts_col) - F.pmod(F.col(ts_col), F.lit(window_ms))


def click_counts(window_ms: int = 5000):
    """foreachBatch step: clicks per code and window within the micro-batch."""
    def fn(batch: DataFrame, batch_id: int) -> DataFrame:
        return batch.groupBy(window_start(window_ms).alias("window_start"), "code").agg(
            F.count(F.lit(1)).alias("count"), F.max("ts_ms").alias("last_accessed_at"))

    return fn


def total_counts(partials: DataFrame) -> DataFrame:
    """Clicks per code and window over all micro-batches: a window may have rows in any of them."""
    return partials.groupBy("window_start", "code").agg(F.sum("count").alias("count"),
                                                        F.max("last_accessed_at").alias("last_accessed_at"))


def apply_flushes(links: DataFrame, root: str):
    """foreachBatch step: add the micro-batch's clicks to a whole link table, as version ``batch_id`` below ``root``.

    For small tables; :func:`commit_flushes` rewrites only the shards with clicks.

    Version n is made from version n - 1 alone (0 from ``links``), so a
    micro-batch that is replayed writes the same version again and counts once.
    """
    spark = links.sparkSession

    def fn(batch: DataFrame, batch_id: int) -> DataFrame:
        last = links if batch_id == 0 else spark.read.schema(links.schema).parquet(f"{root}/version={batch_id - 1}")
        deltas = L.coalesce_clicks(batch)
        L.apply_clicks(last, deltas).write.mode("overwrite").parquet(f"{root}/version={batch_id}")
        return deltas.withColumn("batch_id", F.lit(batch_id))

    return fn


def newest_version(spark: SparkSession, out: str, root: str, schema: T.StructType) -> DataFrame:
    """The link table after the last micro-batch of :func:`apply_flushes`."""
    last = spark.read.parquet(out).agg(F.max("batch_id")).first()[0]
    return spark.read.schema(schema).parquet(f"{root}/version={last}")


def commit_flushes(table: VersionedLinks, keep: int = 2):
    """foreachBatch step: add the micro-batch's clicks to the link table, as version ``batch_id + 1``.

    Only shards with clicks are rewritten. A version is made from the one before it alone, so a
    micro-batch that is replayed writes the same version again and counts once; versions older than the
    last ``keep`` are removed, which must leave the one before the last for a replay.
    """
    if keep < 2:
        raise ValueError(f"keep must be 2 or more, got {keep!r}")

    def fn(batch: DataFrame, batch_id: int) -> DataFrame:
        deltas = L.coalesce_clicks(batch)
        touched = shards_of(deltas, table.shards)
        table.commit(batch_id + 1, touched, lambda rows: L.apply_clicks(rows, deltas))
        table.vacuum(keep)
        return deltas.withColumn("batch_id", F.lit(batch_id))

    return fn


def flush_deltas(batch: DataFrame, batch_id: int) -> DataFrame:
    """Per micro-batch: one delta per code (the flush)."""
    return L.coalesce_clicks(batch).withColumn("batch_id", F.lit(batch_id))


def flush_summary(batch: DataFrame, batch_id: int) -> DataFrame:
    """Per flush: distinct codes and total clicks written."""
    return batch.agg(F.countDistinct("code").alias("codes"), F.count(F.lit(1)).alias("clicks")).withColumn(
        "batch_id", F.lit(batch_id))


def bounded_flushes(max_codes: int):
    """foreachBatch step: the micro-batch's deltas in flushes of at most ``max_codes`` distinct codes.

    Codes are numbered by a range-partitioned sort, so no task holds the whole
    micro-batch, and a replay cuts the same flushes. One row per flush.
    """
    if max_codes < 1:
        raise ValueError(f"max_codes must be positive, got {max_codes!r}")

    def fn(batch: DataFrame, batch_id: int) -> DataFrame:
        placed = global_positions(L.coalesce_clicks(batch), [F.col("code")])
        flush = F.call_function("div", F.col("pos"), F.lit(max_codes))
        return placed.groupBy(flush.alias("flush")).agg(
            F.count(F.lit(1)).alias("codes"), F.sum("count").alias("clicks")).withColumn("batch_id", F.lit(batch_id))

    return fn


def late_split(delay_ms: int, marks: str):
    """foreachBatch step that tags clicks older than the running watermark as late.

    The watermark is the largest event time of earlier batches minus
    ``delay_ms``. Each batch writes its largest event time to ``marks`` (a shared
    folder), so the watermark survives a restart and a replayed batch sees the same one.
    """
    def fn(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        batch.agg(F.max("ts_ms").alias("max_ts")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")
        earlier = spark.read.schema("max_ts bigint, batch bigint").parquet(marks).where(F.col("batch") < batch_id)
        mark = earlier.agg(F.max("max_ts")).first()[0]  # one scalar per micro-batch
        tagged = batch.withColumn("late", F.lit(False) if mark is None else F.col("ts_ms") < F.lit(mark - delay_ms))
        return tagged.groupBy("late").agg(F.count(F.lit(1)).alias("clicks")).withColumn("batch_id", F.lit(batch_id))

    return fn


# ---- stateful limiters online (applyInPandasWithState) ----

LIMIT_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("allowed", T.BooleanType()),
    T.StructField("remaining", T.LongType()), T.StructField("reset_at", T.LongType()),
    T.StructField("retry_after_ms", T.LongType()),
])
#: Buckets of keys; a checkpoint of :func:`stream_sliding_limit` holds for this number.
LIMIT_BUCKETS = 1024
#: Rows that are decided before their decisions are passed on.
BLOCK_ROWS = 65_536
#: A key's log of admitted times, the time of its last row, and by the clock when that came (with an idle time).
LOGS = pa.schema([("key", pa.string()), ("last", pa.int64()), ("log", pa.list_(pa.int64())), ("seen", pa.int64())])
#: What a row lacks.
NO_ID, NO_TS, NO_TIE = 1, 2, 4


def _sorted_rows(pdfs):
    frames = [p for p in pdfs]
    if not frames:
        return pd.DataFrame()
    return pd.concat(frames).sort_values(["ts_ms", "tie"])


def _timeout(idle_ms: int | None) -> str:
    """Without ``idle_ms`` a key keeps its (bounded) state. With it, state goes after that long without a row, by the
    clock; Spark then runs batches without data, so such a query never ends under ``availableNow``."""
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def limit_bucket(key: str) -> Column:
    """The bucket, of ``LIMIT_BUCKETS``, that keeps a key's log."""
    return F.pmod(F.xxhash64(key_text(key)), F.lit(LIMIT_BUCKETS)).cast("int")


def _packed(logs: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, logs.schema) as out:
        out.write_table(logs.combine_chunks())
    return sink.getvalue().to_pybytes()


def _nulled(values: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    return np.where(nulls, None, values.astype(object)) if nulls.any() else values


def _slide(logs: pa.Table, rows: pd.DataFrame, limit: int, window_ms: int,
           now: int | None) -> Iterator[pd.DataFrame | pa.Table]:
    """Decisions on the rows of a bucket's micro-batch, ``BLOCK_ROWS`` at a time; last, the ``logs`` after them.

    A row without time comes last in its micro-batch, finds an empty log and leaves one.
    """
    codes, names = pd.factorize(rows["_key"])
    gaps, times = rows["_gaps"].to_numpy(), rows["_ts"].to_numpy()
    order = np.lexsort((rows["_tie"].to_numpy(), gaps & NO_TIE, times, gaps & NO_TS, codes))
    codes, gaps, times, ids = codes[order], gaps[order], times[order], rows["_id"].to_numpy()[order]
    kept = logs["log"].combine_chunks()
    at = pc.index_in(pa.array(names, pa.string()), value_set=logs["key"].combine_chunks()).to_pylist()
    starts, flat, lasts = kept.offsets.to_pylist(), kept.values.to_numpy(), logs["last"].to_pylist()
    sizes, new_log, new_last = [], [], []
    current, log, last = -1, deque(), None

    def closed() -> None:
        sizes.append(len(log))
        new_log.extend(log)
        new_last.append(last)

    for a in range(0, len(order), BLOCK_ROWS):
        block = slice(a, a + BLOCK_ROWS)
        untimed = (gaps[block] & NO_TS) > 0
        allowed, remaining, reset, retry = [], [], [], []
        for code, t, no_time in zip(codes[block].tolist(), times[block].tolist(), untimed.tolist(), strict=True):
            if code != current:
                if current >= 0:
                    closed()
                current, p = code, at[code]
                log, last = (deque(), None) if p is None else (deque(flat[starts[p]:starts[p + 1]].tolist()), lasts[p])
            if no_time:
                log.clear()
                last = None
            else:
                t = last = t if last is None else max(t, last)
                while log and log[0] <= t - window_ms:
                    log.popleft()
            used = len(log)
            ends = (log[0] if used else t) + window_ms
            reset.append(ends)
            if used >= limit:
                allowed.append(False)
                remaining.append(0)
                retry.append(1 if no_time else max(1, ends - t))
            else:
                allowed.append(True)
                remaining.append(limit - used - 1)
                retry.append(0)
                if not no_time:
                    log.append(t)
        yield pd.DataFrame({
            "event_id": _nulled(ids[block], (gaps[block] & NO_ID) > 0), "allowed": allowed, "remaining": remaining,
            "reset_at": _nulled(np.array(reset, np.int64), untimed), "retry_after_ms": retry})
    closed()
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    touched = pa.table([pa.array(names, pa.string()), pa.array(new_last, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(new_log, pa.int64())),
                        pa.array([now] * len(names), pa.int64())], schema=LOGS)
    others = np.ones(len(logs), bool)
    others[[p for p in at if p is not None]] = False
    yield pa.concat_tables([logs.filter(pa.array(others)), touched])


def sliding_step(limit: int, window_ms: int, idle_ms: int | None = None):
    """Function of a bucket's rows and its state. With ``idle_ms`` a key's log goes that long after its last row, as its
    own state would: not in a micro-batch that has rows of the key."""
    def fn(k, pdfs, state):
        logs = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else LOGS.empty_table()
        now = None if idle_ms is None else state.getCurrentProcessingTimeMs()
        if not state.hasTimedOut:
            for part in _slide(logs, pd.concat(list(pdfs), ignore_index=True), limit, window_ms, now):
                if isinstance(part, pa.Table):
                    logs = part
                else:
                    yield part
        if idle_ms is not None:
            logs = logs.filter(pc.greater_equal(logs["seen"], now - idle_ms))
            if not len(logs):
                state.remove()
                return
            state.setTimeoutDuration(max(1, pc.min(logs["seen"]).as_py() + idle_ms - now))
        state.update((_packed(logs),))

    return fn


def stream_sliding_limit(stream: DataFrame, key: str, limit: int, window_ms: int,
                         idle_ms: int | None = None) -> DataFrame:
    """Sliding-window log per key as state. Rows are ordered inside a micro-batch; an earlier row in a later one counts
    as if it came at the time of the last row.

    A call of Python and a row of state cost far more than a few rows of a key, so both are per bucket of keys: the state
    is an Arrow table of their logs.
    """
    gap = lambda c, bit: F.when(F.col(c).isNull(), bit).otherwise(0)
    full = lambda c: F.coalesce(F.col(c), F.lit(0).cast(stream.schema[c].dataType))
    # whole numbers with nulls among them would reach pandas as floats
    rows = stream.select(
        limit_bucket(key).alias("_bucket"), key_text(key).alias("_key"), full("event_id").cast("long").alias("_id"),
        full("ts_ms").cast("long").alias("_ts"), full("tie").alias("_tie"),
        (gap("event_id", NO_ID) + gap("ts_ms", NO_TS) + gap("tie", NO_TIE)).alias("_gaps"))
    kept = T.StructType([T.StructField("logs", T.BinaryType())])
    return rows.groupBy("_bucket").applyInPandasWithState(sliding_step(limit, window_ms, idle_ms), LIMIT_OUT, kept, "append",
                                                          _timeout(idle_ms))


def stream_token_bucket(stream: DataFrame, key: str, capacity: float, refill: float,
                        idle_ms: int | None = None) -> DataFrame:
    """Token bucket per key as (tokens, ts) state."""
    import math

    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        tokens, lts = (state.get[0], state.get[1]) if state.exists else (None, None)
        rows = _sorted_rows(pdfs)
        out = []
        for ev, t in zip(rows["event_id"].tolist(), rows["ts_ms"].tolist()):
            if tokens is None:
                tokens, lts = capacity, t
            t = max(t, lts)
            elapsed = max(0, t - lts)
            tokens = min(capacity, tokens + (elapsed / 1000.0) * refill)
            if tokens >= 1.0:
                tokens -= 1.0
                allowed, retry = True, 0
            else:
                allowed, retry = False, max(1, math.ceil(((1.0 - tokens) / refill) * 1000.0))
            lts = t
            out.append((ev, allowed, math.floor(tokens), t + math.ceil(((capacity - tokens) / refill) * 1000.0), retry))
        if tokens is not None:
            state.update((tokens, lts))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in LIMIT_OUT.fields])

    st = T.StructType([T.StructField("tokens", T.DoubleType()), T.StructField("ts", T.LongType())])
    return stream.groupBy(key).applyInPandasWithState(fn, LIMIT_OUT, st, "append",
                                                      _timeout(idle_ms))


FILL_OUT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("leader_ts", T.LongType())])


def stream_ttl_first_touch(stream: DataFrame, key: str, ttl_ms: int, idle_ms: int | None = None) -> DataFrame:
    """Online reuse: emit only fills; an entry lives ``ttl`` from its fill (not renewed by hits)."""
    def fn(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        exp, last = (state.get[0], state.get[1]) if state.exists else (None, None)
        rows = _sorted_rows(pdfs)
        out = []
        for ev, t in zip(rows["event_id"].tolist(), rows["ts_ms"].tolist()):
            t = last = t if last is None else max(t, last)
            if exp is None or exp <= t:
                exp = t + ttl_ms
                out.append((ev, t))
        if exp is not None:
            state.update((exp, last))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["event_id", "leader_ts"])

    st = T.StructType([T.StructField("exp", T.LongType()), T.StructField("last", T.LongType())])
    return stream.groupBy(key).applyInPandasWithState(fn, FILL_OUT, st, "append", _timeout(idle_ms))

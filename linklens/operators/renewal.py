"""Renewal chains: a row leads if it comes at or after the expiry of the last leader of its key.

TTL reuse (a fill lives until its expiry, reads in between do not extend it) and
single-flight calls (a call runs until its end, calls in between join it) are both of
this kind. Who leads next depends on the last leader alone, so a chunk of a key's
history is a function: expiry at entry -> last leader at exit. It is a step
function, found for all entries at once by pointer doubling over the successors of
the chunk's rows, and the functions of consecutive chunks compose:

1. Episodes start where no earlier row can still hold: at or after every earlier expiry, or at a reset.
2. An episode that spans several chunks has each chunk's step function computed in a task of its own.
3. Functions are composed by blocks of ``BLOCK`` chunks; the entries of blocks follow from the composed
   functions, the entries of chunks from those of their block.
4. Every chunk marks its leaders from its entry, row after row, with one expiry as its state.

A key that never pauses is therefore spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.operators.chunks import dealt, extended, key_text, numbers, runs, staged
from linklens.session import ship_package

#: Before every time: nothing holds.
NEVER = -(2**63)
#: Chunks composed to one function.
BLOCK = 256
_FUNCTION = "_k string, _ep bigint, _b bigint, bp array<bigint>, ex array<bigint>, el array<bigint>"


def step_function(ts: np.ndarray, expiry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bp, ex, el) of a chunk's rows: entered with expiry x, i being the first place with bp[i] >= x, the chunk's last
    leader has time el[i] and expiry ex[i]. Above all of bp nothing leads and the entry passes through."""
    n = len(ts)
    after = np.maximum(np.searchsorted(ts, expiry, "left"), np.arange(1, n + 1))
    last = np.where(after < n, after, np.arange(n))
    while True:  # doubling: the chain's last row in the chunk
        further = last[last]
        if (further == last).all():
            break
        last = further
    return compressed(ts, expiry[last], ts[last])


def compressed(bp: np.ndarray, ex: np.ndarray, el: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step for each run of equal results; of rows at the same time the first counts."""
    first = np.r_[True, bp[1:] != bp[:-1]] if len(bp) else np.zeros(0, bool)
    bp, ex, el = bp[first], ex[first], el[first]
    keep = np.r_[(ex[1:] != ex[:-1]) | (el[1:] != el[:-1]), True] if len(bp) else np.zeros(0, bool)
    return bp[keep], ex[keep], el[keep]


def composed(f: tuple, g: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First ``f``, then ``g``."""
    (bp, ex, el), (bp2, ex2, el2) = f, g
    at = np.searchsorted(bp2, ex, "left")
    led = at < len(bp2)
    ex, el = np.where(led, ex2[np.minimum(at, len(bp2) - 1)], ex), np.where(led, el2[np.minimum(at, len(bp2) - 1)], el)
    beyond = np.searchsorted(bp2, bp[-1], "right")  # entries that pass through f
    return compressed(np.r_[bp, bp2[beyond:]], np.r_[ex, ex2[beyond:]], np.r_[el, el2[beyond:]])


def applied(f: tuple, entry: tuple[int, int]) -> tuple[int, int]:
    bp, ex, el = f
    i = int(np.searchsorted(bp, entry[0], "left"))
    return entry if i == len(bp) else (int(ex[i]), int(el[i]))


def _functions(batch: pa.RecordBatch) -> list[tuple]:
    cols = [batch.column(batch.schema.get_field_index(c)) for c in ("bp", "ex", "el")]
    return [tuple(c[i].values.to_numpy(zero_copy_only=False) for c in cols) for i in range(batch.num_rows)]


def _function_rows(keys: list[tuple], functions: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
    lists = [pa.array([f[i] for f in functions], pa.list_(pa.int64())) for i in range(3)]
    return pa.RecordBatch.from_arrays([*arrays, *lists], names=["_k", "_ep", "_b", "bp", "ex", "el"])


def chunk_functions(rows: DataFrame) -> DataFrame:
    """The step function of every chunk (_k, _ep, _b) of ``rows`` (and _ts, _exp, _tie)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []

        def closed() -> pa.RecordBatch:
            return _function_rows([last], [step_function(*map(np.concatenate, zip(*parts, strict=True)))])

        for batch in batches:
            ts, expiry = numbers(batch, "_ts"), numbers(batch, "_exp")
            for a, b, goes_on, key in runs(batch, ["_k", "_ep", "_b"], last):
                if not goes_on:
                    if parts:
                        yield closed()
                    last, parts = key, []
                parts.append((ts[a:b], expiry[a:b]))
        if parts:
            yield closed()

    cols = ["_k", "_ep", "_b", "_ts", "_exp", "_tie"]
    return dealt(rows.select(*cols), ["_k", "_ep", "_b"], ["_ts", "_tie"]).mapInArrow(summarise, _FUNCTION)


def block_functions(functions: DataFrame) -> DataFrame:
    """Functions of blocks of consecutive chunks; _b becomes the block's number."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, f = None, None
        for batch in batches:
            own = _functions(batch)
            for a, b, goes_on, key in runs(batch, ["_k", "_ep", "_block"], last):
                if not goes_on:
                    if f is not None:
                        yield _function_rows([last], [f])
                    last, f = key, None
                for g in own[a:b]:
                    f = g if f is None else composed(f, g)
        if f is not None:
            yield _function_rows([last], [f])

    rows = functions.withColumn("_block", F.floor(F.col("_b") / BLOCK))
    return dealt(rows, ["_k", "_ep", "_block"], ["_b"]).mapInArrow(compose, _FUNCTION)


def entries(functions: DataFrame, group: list[str]) -> DataFrame:
    """(_k, _ep, _b, in_exp, in_ts): the state in which each function of a ``group`` is entered.

    A group starts from its rows' in_exp, in_ts; the rest follows by applying one function after the other.
    """

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, (NEVER, NEVER)
        for batch in batches:
            own, in_exp, in_ts = _functions(batch), numbers(batch, "in_exp"), numbers(batch, "in_ts")
            states = []
            for a, b, goes_on, key in runs(batch, group, last):
                if not goes_on:
                    last, state = key, (int(in_exp[a]), int(in_ts[a]))
                for f in own[a:b]:
                    states.append(state)
                    state = applied(f, state)
            found = [pa.array([s[i] for s in states], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in ("_k", "_ep", "_b")] + found,
                names=["_k", "_ep", "_b", "in_exp", "in_ts"])

    return dealt(functions, group, ["_b"]).mapInArrow(evaluate, "_k string, _ep bigint, _b bigint, in_exp bigint, in_ts bigint")


def chunk_entries(rows: DataFrame) -> DataFrame:
    """The state in which every chunk of an episode of several chunks is entered."""
    several = rows.filter("_b > 0").select("_k", "_ep").distinct()
    functions = chunk_functions(rows.join(several, ["_k", "_ep"], "left_semi"))
    none = [F.lit(NEVER).alias("in_exp"), F.lit(NEVER).alias("in_ts")]
    of_blocks = entries(block_functions(functions).select("*", *none), ["_k", "_ep"]).withColumnRenamed("_b", "_block")
    inside = functions.withColumn("_block", F.floor(F.col("_b") / BLOCK)).join(of_blocks, ["_k", "_ep", "_block"])
    return entries(inside, ["_k", "_ep", "_block"])


def leaders(rows: DataFrame, names: list[str], key: str, chunk_ms: int) -> DataFrame:
    """The columns ``names`` of ``rows`` with _lead and _leader_ts.

    ``rows`` also holds _ep and _ep_ts (number and start of the episode), _ts, _exp, _tie.
    """
    ship_package(rows.sparkSession)
    own, kept = ["_k", "_ep", "_b", "_ts", "_exp", "_tie"], names
    rows = rows.withColumn("_k", key_text(key)).withColumn("_b", F.floor((F.col("_ts") - F.col("_ep_ts")) / chunk_ms).cast("bigint"))
    rows = staged(rows.select(*kept, *own), "renewal-rows")  # read by every step from here on
    if rows.filter("_b > 0").isEmpty():
        met = rows.withColumns({c: F.lit(NEVER) for c in ("in_exp", "in_ts")})
    else:
        met = rows.join(chunk_entries(rows), ["_k", "_ep", "_b"], "left")
        met = met.withColumns({c: F.coalesce(c, F.lit(NEVER)) for c in ("in_exp", "in_ts")})
    own += ["in_exp", "in_ts"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, (NEVER, NEVER)
        for batch in batches:
            ts, expiry, in_exp, in_ts = (numbers(batch, c) for c in ("_ts", "_exp", "in_exp", "in_ts"))
            lead, leader = np.zeros(len(ts), bool), np.empty(len(ts), np.int64)
            for a, b, goes_on, key in runs(batch, ["_k", "_ep", "_b"], last):
                if not goes_on:
                    last, state = key, (int(in_exp[a]), int(in_ts[a]))
                while a < b:
                    i = a + int(np.searchsorted(ts[a:b], state[0], "left"))
                    leader[a:i] = state[1]
                    if i < b:
                        state = (int(expiry[i]), int(ts[i]))
                        lead[i], leader[i] = True, state[1]
                    a = i + 1
            yield extended(batch, set(own), {"_lead": pa.array(lead), "_leader_ts": pa.array(leader)})

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return dealt(met, ["_k", "_ep", "_b"], ["_ts", "_tie"]).mapInArrow(mark, f"{schema}, _lead boolean, _leader_ts bigint")

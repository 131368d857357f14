"""Per-row codecs as native Catalyst expressions (no Python UDFs).

Base62 short codes, FNV-1a 32-bit shard hashing, Snowflake-style 63-bit IDs and
the keyset cursor. Every function takes a Column (or a column name) and returns
a Column, so the work stays inside whole-stage codegen.
"""

from __future__ import annotations

import base64
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for identical codes and shards) ---
BASE62_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FNV_OFFSET_BASIS = 2166136261  # 0x811C9DC5
FNV_PRIME = 16777619  # 0x01000193
ID_EPOCH_MS = 1704067200000  # 2024-01-01T00:00:00Z
NODE_BITS = 10
SEQUENCE_BITS = 12
# ------------------------------------------------------------------------------

MAX_NODE = (1 << NODE_BITS) - 1
MAX_SEQUENCE = (1 << SEQUENCE_BITS) - 1
SEQ_PER_MS = 1 << SEQUENCE_BITS
TIMESTAMP_SHIFT = NODE_BITS + SEQUENCE_BITS

# 62^0 .. 62^10: a non-negative BIGINT has at most 11 Base62 digits.
_POW62 = [62 ** k for k in range(11)]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def idiv(a, b) -> Column:
    """Integral division (SQL ``div``) without a double round trip."""
    return F.call_function("div", _c(a), b if isinstance(b, Column) else F.lit(b))


def base62_encode(col) -> Column:
    """Non-negative long -> Base62 text; 0 -> "0"; negative or null -> null."""
    n = _c(col).cast("long")
    digits = [
        F.substring(F.lit(BASE62_ALPHABET), (idiv(n, p) % 62 + 1).cast("int"), 1)
        for p in reversed(_POW62)
    ]
    text = F.regexp_replace(F.concat(*digits), "^0+(.)", "$1")
    return F.when(n >= 0, text)


def base62_decode(col) -> Column:
    """Base62 text -> long; empty, foreign character or > 2^63-1 -> null."""
    s = _c(col)
    chars = F.split(s, "")
    folded = F.aggregate(
        chars,
        F.lit(0).cast("long"),
        lambda acc, ch: F.when(
            F.instr(F.lit(BASE62_ALPHABET), ch) > 0,
            F.try_add(F.try_multiply(acc, F.lit(62).cast("long")),
                      (F.instr(F.lit(BASE62_ALPHABET), ch) - 1).cast("long")),
        ),
    )
    return F.when((F.length(s) > 0) & s.rlike("^[0-9A-Za-z]+$"), folded)


def utf16_units(col) -> Column:
    """Array of UTF-16 code units (what JavaScript's charCodeAt walks)."""
    c = _c(col)
    # ascii() gives a character's code point, which is its unit for all but the characters above U+FFFF
    units = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("long"))
    return F.when(c == "", F.array().cast("array<bigint>")).when(
        c.rlike(r"[\x{10000}-\x{10FFFF}]"), _utf16_hex(c)).otherwise(units)


def _utf16_hex(col) -> Column:
    hexed = F.hex(F.encode(_c(col), "UTF-16BE"))
    return F.transform(F.regexp_extract_all(hexed, F.lit("(.{4})"), 1),
                       lambda h: F.conv(h, 16, 10).cast("long"))


def fnv1a32(col) -> Column:
    """FNV-1a 32-bit over UTF-16 code units, as an unsigned value in a long."""
    return F.aggregate(
        utf16_units(col),
        F.lit(FNV_OFFSET_BASIS).cast("long"),
        lambda acc, u: ((acc.bitwiseXOR(u)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)),
    )


def fnv1a32_literal(text: str) -> int:
    """Driver-side FNV-1a for a caller's literal (used to prune shards at plan time)."""
    data = text.encode("utf-16-be")
    h = FNV_OFFSET_BASIS
    for i in range(0, len(data), 2):
        h = ((h ^ ((data[i] << 8) | data[i + 1])) * FNV_PRIME) & 0xFFFFFFFF
    return h


def bucket_of(col, buckets: int) -> Column:
    """``fnv1a32(key) % buckets``; one bucket -> 0. Shard routing uses this."""
    if not isinstance(buckets, int) or buckets < 1:
        raise ValueError(f"buckets must be a positive integer, got {buckets!r}")
    if buckets == 1:
        return F.lit(0).cast("int")
    return (fnv1a32(col) % F.lit(buckets)).cast("int")


shard_for = bucket_of


def server_for(shard_col, servers: int) -> Column:
    if servers < 1:
        raise ValueError("servers must be >= 1")
    return (_c(shard_col) % F.lit(servers)).cast("int")


def snowflake_ts(col) -> Column:
    return F.shiftright(_c(col), TIMESTAMP_SHIFT) + F.lit(ID_EPOCH_MS)


def snowflake_node(col) -> Column:
    return F.shiftright(_c(col), SEQUENCE_BITS).bitwiseAND(F.lit(MAX_NODE))


def snowflake_seq(col) -> Column:
    return _c(col).bitwiseAND(F.lit(MAX_SEQUENCE))


def snowflake_id(ms_col, node_col, seq_col) -> Column:
    """Compose ``(ms - epoch) << 22 | node << 12 | seq``."""
    return (F.shiftleft(_c(ms_col) - F.lit(ID_EPOCH_MS), TIMESTAMP_SHIFT)
            .bitwiseOR(F.shiftleft(_c(node_col).cast("long"), SEQUENCE_BITS))
            .bitwiseOR(_c(seq_col).cast("long")))


def _b64url(binary: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(binary), "+/", "-_"), "=+$", "")


def encode_cursor(created_col, id_col) -> Column:
    """base64url (no padding) of ``"<created_at>:<id>"``."""
    raw = F.concat_ws(":", _c(created_col).cast("string"), _c(id_col).cast("string"))
    return _b64url(F.encode(raw, "UTF-8"))


def decode_cursor_literal(cursor: str) -> tuple[int | float, int] | None:
    """(created_at, id) of a cursor on the driver, or null when malformed; whole times are whole numbers."""
    try:
        text = base64.b64decode(cursor.translate(str.maketrans("-_", "+/")) + "=" * (-len(cursor) % 4), validate=True).decode()
        head, _, tail = text.partition(":")
        at, last = float(head), int(tail)
    except (ValueError, UnicodeDecodeError):
        return None
    if not math.isfinite(at):
        return None
    return (int(at) if at.is_integer() else at), last


def decode_cursor(col) -> Column:
    """Cursor text -> struct<created_at double, id string>, or null when malformed.

    Malformed means: not base64url, no ``:`` at index >= 1, a non-finite number
    before it, or an empty id after it.
    """
    s = F.translate(_c(col), "-_", "+/")
    pad = ((F.lit(4) - F.length(s) % 4) % 4).cast("int")
    raw = F.try_to_binary(F.concat(s, F.repeat(F.lit("="), pad)), F.lit("base64"))
    text = F.when(F.length(s) % 4 != 1, F.decode(raw, "UTF-8"))
    idx = F.instr(text, ":")
    head = F.substring_index(text, ":", 1)
    tail = F.substring(text, (idx + 1).cast("int"), 1 << 30)
    num = F.trim(head).try_cast("double")
    ok = ((idx >= 2) & num.isNotNull() & ~F.isnan(num)
          & (F.abs(num) != F.lit(float("inf"))) & (F.length(tail) > 0))
    return F.when(ok, F.struct(num.alias("created_at"), tail.alias("id")))

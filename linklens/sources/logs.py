"""Log sources: balancer access lines and JSON log records.

Readers never fail the job on a bad line: access lines that do not match the
format are kept with ``parse_ok = false``; JSON records that do not parse are
dropped by the level filter (their level is null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linklens.functions.text import REDACT_KEYS, mask_secret

# --- fixed values ---
LEVEL_RANK = {"debug": 10, "info": 20, "warn": 30, "error": 40, "silent": 100}
MAX_REDACT_DEPTH = 6
# Access line: addr - [time] "request" status bytes rt=.. upstream=.. urt=.. cache=.. rid=..
ACCESS_RE = (r'^(\S+) - \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d{3}) (\d+) rt=(\S+) upstream=(.+?) '
             r'urt=(.+?) cache=(\S+) rid=(\S+)$')
TIME_LOCAL = "dd/MMM/yyyy:HH:mm:ss Z"
# --------------------


def render_access_line(addr, ts_ms, method, path, status, nbytes, rt, upstream, urt, cache, rid) -> Column:
    t = F.date_format(F.timestamp_millis(ts_ms), "dd/MMM/yyyy:HH:mm:ss +0000")
    return F.concat(addr, F.lit(" - ["), t, F.lit('] "'), method, F.lit(" "), path, F.lit(' HTTP/1.1" '),
                    status.cast("string"), F.lit(" "), nbytes.cast("string"), F.lit(" rt="), rt,
                    F.lit(" upstream="), upstream, F.lit(" urt="), urt, F.lit(" cache="), cache,
                    F.lit(" rid="), rid)


def parse_access_log(lines: DataFrame, col: str = "value") -> DataFrame:
    """Access lines -> typed columns plus ``parse_ok``; unparsable lines keep null fields."""
    v = F.col(col)
    ok = v.rlike(ACCESS_RE)

    def g(i):
        return F.when(ok, F.regexp_extract(v, ACCESS_RE, i))

    ts = F.try_to_timestamp(g(2), F.lit(TIME_LOCAL))
    return lines.select(
        g(1).alias("client"),
        F.unix_millis(ts).alias("ts_ms"),
        g(3).alias("method"), g(4).alias("path"),
        g(6).try_cast("int").alias("status"), g(7).try_cast("long").alias("bytes"),
        g(8).try_cast("double").alias("rt"), g(9).alias("upstream"),
        # a retried request lists an upstream and a time for each try; the last one answered
        F.regexp_extract(g(10), r"([0-9.]+)$", 1).try_cast("double").alias("urt"),
        g(11).alias("cache"), g(12).alias("request_id"),
        ok.alias("parse_ok"),
    )


LOG_SCHEMA = T.StructType([
    T.StructField("ts", T.StringType()), T.StructField("level", T.StringType()),
    T.StructField("msg", T.StringType()), T.StructField("requestId", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("route", T.StringType()),
    T.StructField("status", T.IntegerType()), T.StructField("durationMs", T.DoubleType()),
])


def structured_log(lines: DataFrame, min_level: str = "info", col: str = "value",
                   schema: T.StructType = LOG_SCHEMA, bindings: str | None = None) -> DataFrame:
    """JSON lines -> records at or above ``min_level``; malformed lines never fail the job.

    ``bindings`` names a column for what the schema does not hold: the free
    fields of a line by name, texts as they are, other values as JSON.
    """
    rank = F.create_map(*[x for kv in LEVEL_RANK.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    permissive = {"mode": "PERMISSIVE"}
    free = [] if bindings is None else [F.from_json(F.col(col), "map<string,string>", permissive).alias("_free")]
    rec = lines.select(F.from_json(F.col(col), schema, permissive).alias("r"), *free)
    named = [] if bindings is None else [
        F.map_filter("_free", lambda k, v: ~k.isin(*schema.fieldNames())).alias(bindings)]
    rec = rec.select("r.*", *named)
    return rec.where(F.try_element_at(rank, F.col("level")) >= F.lit(LEVEL_RANK[min_level]))


def _redact(c: Column, dt: T.DataType, depth: int) -> Column:
    """Schema-driven rewrite: mask sensitive field names in structs (recursively), arrays and maps."""
    if depth > MAX_REDACT_DEPTH:
        return c
    if isinstance(dt, T.StructType):
        fields = []
        for f in dt.fields:
            sub = c.getField(f.name)
            if f.name.lower() in REDACT_KEYS:
                masked = mask_secret(sub) if isinstance(f.dataType, T.StringType) else F.lit("***")
                fields.append(masked.alias(f.name))
            else:
                fields.append(_redact(sub, f.dataType, depth + 1).alias(f.name))
        return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(*fields))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _redact(x, dt.elementType, depth + 1))
    if isinstance(dt, T.MapType) and isinstance(dt.keyType, T.StringType):
        inner = dt.valueType

        def value(k: Column, v: Column) -> Column:
            secret = F.lower(k).isin(REDACT_KEYS)
            if isinstance(inner, T.StringType):
                return F.when(secret, mask_secret(v)).otherwise(v)
            if isinstance(inner, (T.StructType, T.ArrayType, T.MapType)):
                # a map has one value type, so a secret that is no text becomes null
                return F.when(~F.coalesce(secret, F.lit(False)), _redact(v, inner, depth + 1))
            return F.when(secret, F.lit("***")).otherwise(v.cast("string"))

        return F.transform_values(c, value)
    return c


def redact_log(df: DataFrame, col: str) -> DataFrame:
    """Replace struct column ``col`` with its redacted form (13 field names, depth <= 6).

    Strings of length <= 8 become ``***``, longer ones keep the first 4 and last
    2 characters; non-string values become ``***`` (so a masked field turns into
    a string).
    """
    dt = df.schema[col].dataType
    return df.withColumn(col, _redact(F.col(col), dt, 0))

"""Prometheus text exposition: render samples to lines, parse lines back to samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.operators.metrics import LATENCY_BUCKETS, canonical_labels

# --- fixed values ---
REQUESTS = "linklens_http_requests_total"
DURATION = "linklens_http_request_duration_seconds"
LATEST = "linklens_latest_latency_seconds"
TOTAL = "linklens_requests_seen_total"
HELP = {
    REQUESTS: "Requests answered, split by route, method and status",
    DURATION: "Time to answer a request, in seconds",
    LATEST: "Time to answer the latest request, in seconds",
    TOTAL: "Requests answered by all instances",
}
# --------------------


def fmt_number(c: Column) -> Column:
    """Values in plain decimals, integral ones without a point; NaN, +Inf and -Inf as the text format spells them."""
    size = F.abs(c)
    # a double has 17 digits: near zero they stand further behind the point
    plain = F.when(size < 1e-3, c.cast("decimal(38,30)").cast("string")).otherwise(
        c.try_cast("decimal(38,17)").cast("string"))
    short = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return (F.when(F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf")
            .when((size < 2.0**53) & (c == F.floor(c)), F.floor(c).cast("long").cast("string"))
            .when((size < 1e-12) | (size >= 1e20), c.cast("string")).otherwise(short))


HISTOGRAM_KINDS = ("histogram",)
SAMPLES = ("metric string, kind string, labels map<string,string>, value double, "
           "buckets array<struct<le:double,n:bigint>>, sum double, count bigint")


def render(samples: DataFrame, help_text: Mapping[str, str] = HELP) -> DataFrame:
    """Lines (metric, line) of the text format for any set of samples, in the order of the text.

    ``samples``: rows of ``SAMPLES``, one for each metric and label set; counters
    and gauges have a ``value``, histograms cumulative ``buckets`` (without the
    one of all), ``sum`` and ``count``. A metric's lines stand together after its
    HELP (where ``help_text`` has one) and TYPE; label sets in order of their
    text, buckets by ``le``, then sum and count. Without labels there are no
    braces. Metrics without a sample have no line. One range partitioning orders
    all lines; nothing is gathered.
    """
    key = F.coalesce(canonical_labels(F.coalesce("labels", F.create_map().cast("map<string,string>"))), F.lit(""))
    s = samples.withColumn("_key", key)
    name, k = F.col("metric"), F.col("_key")
    braces = F.when(k == "", F.lit("")).otherwise(F.concat(F.lit("{"), k, F.lit("}")))
    before_le = F.when(k == "", F.lit("")).otherwise(F.concat(k, F.lit(",")))

    def entry(part: int, line: Column, le: Column | None = None) -> Column:
        return F.struct(F.lit(part).alias("part"), (F.lit(None) if le is None else le).cast("double").alias("le"),
                        line.alias("line"))

    def bucket(le: Column, n: Column) -> Column:
        return entry(2, F.concat(name, F.lit("_bucket{"), before_le, F.lit('le="'), fmt_number(le), F.lit('"} '),
                                 n.cast("string")), le)

    scalar = F.array(entry(2, F.concat(name, braces, F.lit(" "), fmt_number(F.col("value")))))
    histogram = F.concat(
        F.transform("buckets", lambda b: bucket(b["le"], b["n"])),
        F.array(bucket(F.lit(float("inf")), F.col("count")),
                entry(3, F.concat(name, F.lit("_sum"), braces, F.lit(" "), fmt_number(F.col("sum")))),
                entry(4, F.concat(name, F.lit("_count"), braces, F.lit(" "), F.col("count").cast("string")))))
    body = s.select("metric", "_key", F.explode(F.when(F.col("kind").isin(*HISTOGRAM_KINDS), histogram).otherwise(scalar))
                    .alias("e")).select("metric", "_key", "e.*")
    helps = F.create_map(*[F.lit(x) for kv in help_text.items() for x in kv]).cast("map<string,string>")
    text = F.try_element_at(helps, name)
    heads = s.groupBy("metric").agg(F.min("kind").alias("kind")).select(
        "metric", F.lit("").alias("_key"), F.explode(F.array(
            entry(0, F.concat(F.lit("# HELP "), name, F.lit(" "), text)),
            entry(1, F.concat(F.lit("# TYPE "), name, F.lit(" "), F.col("kind"))))).alias("e")).select("metric", "_key", "e.*")
    heads = heads.where(F.col("line").isNotNull())
    # headers first, then label set by label set
    return (body.unionByName(heads).orderBy("metric", F.col("part") > 1, "_key", "part", "le").select("metric", "line"))


def scalar_samples(df: DataFrame, kind: str) -> DataFrame:
    """Counters or gauges (metric, labels, value) as rows of ``SAMPLES``."""
    return df.select("metric", F.lit(kind).alias("kind"), "labels", F.col("value").cast("double").alias("value"),
                     F.lit(None).cast("array<struct<le:double,n:bigint>>").alias("buckets"),
                     F.lit(None).cast("double").alias("sum"), F.lit(None).cast("bigint").alias("count"))


def histogram_samples(hist: DataFrame, metric: str, labels: Column) -> DataFrame:
    """Output of ``latency_histogram`` as rows of ``SAMPLES``; sums with 6 decimals."""
    buckets = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{str(b).replace('.', '_')}").cast("bigint").alias("n"))
                        for b in LATENCY_BUCKETS])
    return hist.select(F.lit(metric).alias("metric"), F.lit("histogram").alias("kind"), labels.alias("labels"),
                       F.lit(None).cast("double").alias("value"), buckets.alias("buckets"),
                       F.round("sum_s", 6).alias("sum"), F.col("count").cast("bigint").alias("count"))


def _unescape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    c = F.replace(c, F.lit("\\n"), F.lit("\n"))
    c = F.replace(c, F.lit('\\"'), F.lit('"'))
    return F.replace(c, F.lit("\u0000"), F.lit("\\"))


LABEL_RE = r'([a-zA-Z_][a-zA-Z0-9_]*)="((?:[^"\\]|\\.)*)"'


def parse(text: DataFrame) -> DataFrame:
    """Text lines (column ``value``) -> samples (name, labels map, value).

    Comments, blank lines and lines whose value is not a finite number are
    dropped; labels are extracted and unescaped; a missing label set is an
    empty map.
    """
    line = F.col("value")
    keep = text.where(~line.startswith("#") & (F.trim(line) != ""))
    val = F.substring_index(line, " ", -1).try_cast("double")
    name = F.regexp_extract(line, r"^([a-zA-Z_:][a-zA-Z0-9_:]*)", 1)
    body = F.regexp_extract(line, r"\{(.*)\}", 1)
    keys = F.regexp_extract_all(body, F.lit(LABEL_RE), 1)
    vals = F.transform(F.regexp_extract_all(body, F.lit(LABEL_RE), 2), _unescape)
    read = keep.select(name.alias("name"), keys.alias("_k"), vals.alias("_v"), val.alias("value"))
    # a label given twice keeps its first value
    firsts = F.filter(F.transform("_k", lambda k, i: F.struct(k.alias("key"), F.get("_v", i).alias("value"), i.alias("at"))),
                      lambda e: F.array_position(F.col("_k"), e["key"]) == e["at"] + 1)
    labels = F.map_from_entries(F.transform(firsts, lambda e: F.struct(e["key"], e["value"])))
    out = read.select("name", labels.alias("labels"), "value")
    return out.where(F.col("value").isNotNull() & ~F.isnan("value")
                     & (F.abs(F.col("value")) != F.lit(float("inf"))))

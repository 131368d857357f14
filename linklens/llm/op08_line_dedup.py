"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A passage is a run of consecutive lines; lines without a word neither count nor
break a run and are deleted with a run that they stand in. Passages of ``MIN_WORDS`` words or more that
stand earlier in the corpus (smaller id, then earlier in the text) are deleted.

* A window starts (or ends) at each line and takes as few lines as hold
  ``MIN_WORDS`` words. Its least line hash is a fingerprint. A repeated passage
  contains a whole window, which has the same minimum wherever the passage
  stands, so every repeated passage has a repeated fingerprint.
* Fingerprints are counted over the corpus and positions joined with the
  repeated ones.
* From there matches are extended both ways: the windows round a repeated
  fingerprint are compared by their whole content, and those that are not the
  first with their content are deleted. Every line of a repeated passage lies in
  a repeated window that starts or ends inside the passage, so this deletes
  exactly the lines of repeated passages, however long.

Nothing is paired with anything but the first window of its content, so a
passage with millions of copies costs as many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.llm.common import WORD, free_prefix, materialise, query, row_key, table

MIN_WORDS = 50
#: Lines tried first for a window; most windows need no more.
FEW = 4


def _window(i: Column, step: int) -> Column:
    """Window from line ``i`` onwards (``step`` 1) or up to it (-1): its places and its least line hash.

    The text's lines are bound as ``hs`` (hashes), ``ns`` (words) and ``ats`` (line
    numbers). Every line has a word, so a window has ``MIN_WORDS`` lines at most.
    """
    def taken(most: int) -> Column:
        end = F.least(i + (most - 1), F.size("hs") - 1) if step > 0 else F.greatest(i - (most - 1), F.lit(0))
        none = F.struct(F.lit(0).alias("words"), F.lit(-1).alias("end"), F.lit(None).cast("bigint").alias("print"),
                        F.lit(-1).alias("anchor"))

        def add(acc: Column, j: Column) -> Column:
            h = F.get("hs", j)
            less = acc["print"].isNull() | (h < acc["print"])
            return F.when(acc["words"] >= MIN_WORDS, acc).otherwise(F.struct(
                (acc["words"] + F.get("ns", j)).alias("words"), j.alias("end"),
                F.when(less, h).otherwise(acc["print"]).alias("print"),
                F.when(less, j).otherwise(acc["anchor"]).alias("anchor")))

        return F.aggregate(F.sequence(i, end, F.lit(step)), none, add)

    # results that are used more than once are bound by one-element transforms
    best = F.transform(F.array(taken(FEW)), lambda t: F.when(t["words"] >= MIN_WORDS, t).otherwise(taken(MIN_WORDS)))

    def describe(t: Column) -> Column:
        first, last = (i, t["end"]) if step > 0 else (t["end"], i)
        body = F.transform(F.sequence(first, last), lambda j: F.get("hs", j))
        return F.when(t["words"] >= MIN_WORDS, F.transform(F.array(body), lambda c: F.struct(
            F.get("ats", first).alias("lo"), F.get("ats", last).alias("hi"), t["print"].alias("print"),
            t["anchor"].alias("anchor"), F.xxhash64(c).alias("c1"), F.xxhash64(F.lit(1), c).alias("c2")))[0])

    return F.transform(best, describe)[0]


def line_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k_id, k_text, windows (forward and backward, distinct) of each text; null or empty if words lack."""
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    lines = F.filter(F.transform(split, lambda line, i: F.struct(
        F.xxhash64(line).alias("h"), F.regexp_count(line, F.lit(WORD)).alias("n"), i.alias("at"))),
        lambda x: x["n"] > 0)
    base = docs.select(*row_key(id_col, text_col), lines.alias("lines"))
    # as arrays of their own; lines.h would be taken out of the structs anew at every use
    flat = base.select("k_id", "k_text", F.transform("lines", lambda x: x["h"]).alias("hs"),
                       F.transform("lines", lambda x: x["n"]).alias("ns"),
                       F.transform("lines", lambda x: x["at"]).alias("ats"))
    every = F.sequence(F.lit(0), F.size("hs") - 1)
    both = F.concat(F.transform(every, lambda i: _window(i, 1)), F.transform(every, lambda i: _window(i, -1)))
    # no filter on these arrays: it would be pushed below the projections that bind them, and compute all of it twice
    return flat.select("k_id", "k_text", F.when(F.size("hs") > 0, F.array_distinct(F.array_compact(both))).alias("windows"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k_id, k_text, gone): places (from 0, ascending) of the lines to delete, for texts that have any."""
    texts = materialise(line_windows(docs, id_col, text_col), "windows")
    prints = texts.select(F.explode(F.array_distinct(F.transform(
        "windows", lambda w: F.struct(w["print"].alias("print"), w["anchor"].alias("anchor"))))).alias("p"))
    repeated = prints.groupBy("p.print").agg(F.count("*").alias("n")).filter("n > 1").select("print")
    # extension both ways: the windows round repeated fingerprints, compared by their whole content (128 bits)
    near = materialise(texts.select("k_id", "k_text", F.explode("windows").alias("w"))
                       .select("k_id", "k_text", "w.lo", "w.hi", "w.print", "w.c1", "w.c2")
                       .join(repeated, "print", "left_semi").drop("print"), "near")
    firsts = (near.groupBy("c1", "c2").agg(F.min(F.struct("k_id", "k_text", "lo")).alias("origin"),
                                           F.count("*").alias("n")).filter("n > 1").select("c1", "c2", "origin"))
    later = near.join(firsts, ["c1", "c2"]).filter(~F.struct("k_id", "k_text", "lo").eqNullSafe(F.col("origin")))
    runs = later.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    places = F.flatten(F.transform("runs", lambda r: F.sequence(r["lo"], r["hi"])))
    return runs.select("k_id", "k_text", F.sort_array(F.array_distinct(places)).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with later repeated passages deleted from the text; ``counts`` names columns for lines and lines deleted.

    Null texts stay null and empty ones empty. Documents come in the order of
    their ids, null first; documents that share an id in the order of a hash of
    the text; repeated rows (same id, same text) are one document and get equal
    results. All other columns stay as they are. An empty table stays empty.
    """
    names, p = docs.columns, free_prefix(docs)
    g_id, g_text, own_id, own_hash, at_lines, lines = (f"{p}{n}" for n in ("g_id", "g_text", "id", "hash", "gone", "lines"))
    gone = repeated_lines(docs, id_col, text_col).toDF(g_id, g_text, at_lines)
    own = docs.select("*", *[c.alias(n) for c, n in zip(row_key(id_col, text_col), (own_id, own_hash), strict=True)])
    joined = own.join(gone, (F.col(own_hash) == F.col(g_text)) & F.col(own_id).eqNullSafe(F.col(g_id)), "left")
    lined = joined.select(*names, at_lines, F.split(F.col(text_col), "\n").alias(lines))
    n = F.size(at_lines)
    # what stands between one deleted line and the next
    between = F.transform(at_lines, lambda at, i: F.slice(
        F.col(lines), F.coalesce(F.get(at_lines, i - 1), F.lit(-1)) + 2,
        at - F.coalesce(F.get(at_lines, i - 1), F.lit(-1)) - 1))
    rest = F.slice(F.col(lines), F.get(at_lines, n - 1) + 2, F.size(lines))
    kept = F.array_join(F.flatten(F.concat(between, F.array(rest))), "\n")
    text = F.when(F.col(at_lines).isNull(), F.col(text_col)).otherwise(kept)
    extra = [] if counts is None else [
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(counts[0]),
        F.coalesce(F.size(at_lines), F.lit(0)).cast("long").alias(counts[1])]
    return lined.select(*[text.alias(c) if c == text_col else F.col(c) for c in names], *extra)


def _oracle() -> str:
    return f"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, i AS pos, ls[i] AS line, len(regexp_extract_all(ls[i], '{WORD}')) AS w
      FROM l, unnest(range(1, len(ls) + 1)) AS r(i)),
x AS (SELECT doc_id, pos, line, w, row_number() OVER p AS k, sum(w) OVER p AS upto
      FROM u WHERE w > 0 WINDOW p AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
f AS (SELECT a.doc_id, a.k AS first, min(b.k) AS last FROM x a JOIN x b
      ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY ALL),
b AS (SELECT b.doc_id, max(a.k) AS first, b.k AS last FROM x a JOIN x b
      ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY b.doc_id, b.k),
w AS (SELECT * FROM f UNION SELECT * FROM b),
c AS (SELECT w.doc_id, w.first, min(x.pos) AS lo, max(x.pos) AS hi, string_agg(x.line, chr(10) ORDER BY x.k) AS body
      FROM w JOIN x ON x.doc_id = w.doc_id AND x.k BETWEEN w.first AND w.last GROUP BY w.doc_id, w.first, w.last),
o AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS rn FROM c),
g AS (SELECT DISTINCT u.doc_id, u.pos FROM o JOIN u ON u.doc_id = o.doc_id AND u.pos BETWEEN o.lo AND o.hi
      WHERE o.rn > 1),
s AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id)
SELECT l.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(
    list_transform(ls, lambda v, i: {{'v': v, 'i': i}}), lambda e: NOT list_contains(gone, e.i)), lambda e: e.v), chr(10)), '')
  END AS text
FROM l LEFT JOIN s ON l.doc_id = s.doc_id"""


@query("op8_line_dedup", _oracle())
def op8_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=("n_lines", "n_removed"))

"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

A test item is found in a document if the document holds at least ``PERCENT``
percent of the item's distinct five-word shingles. Similarity of whole
documents says nothing there, as a document may be a thousand times longer, so
the sketch is taken of the item alone: its k least shingle hashes. Items are
partitioned by size, and k is chosen for each partition from its largest item,
such that a document with enough of an item's shingles must hold one of the k:
of n shingles at most n - ceil(0.75 n) may be absent. Documents that hold a sketch hash
are candidates and are verified on all shingles of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.llm.common import ascii_lower, materialise, query, row_key, table, without_rows, words

PERCENT, SHINGLE = 75, 5
#: Bits of the filter through which documents' hashes go before any join: 512 KB, whatever the benchmark's size. Beyond
#: some hundred thousand items they let more hashes through to the joins, which stay right.
FILTER_BITS = 1 << 22


def shingle_array(text: Column) -> tuple[Column, Column]:
    """(words of the text, their shingle hashes); the second refers to the first by the name ``ws``."""
    n = F.size("ws")
    hashed = F.transform(F.sequence(F.lit(0), n - SHINGLE),
                         lambda i: F.xxhash64(*[F.get("ws", i + k) for k in range(SHINGLE)]))
    return words(ascii_lower(text)), (
        F.when(n >= SHINGLE, hashed).when(n > 0, F.array(F.xxhash64("ws"))).otherwise(F.array().cast("array<bigint>")))


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(i_id, i_text, n_item, shingles, sketch) of every distinct item with a word.

    Size partitions hold items of up to 2, 4, 8, ... shingles; ``sketch`` is as long as the partition's largest item asks.
    """
    split, hashed = shingle_array(F.col(text_col))
    keyed = items.select(*[c.alias(n) for c, n in zip(row_key(id_col, text_col), ("i_id", "i_text"), strict=True)],
                         split.alias("ws")).dropDuplicates(["i_id", "i_text"])
    sets = (keyed.select("i_id", "i_text", F.sort_array(F.array_distinct(hashed)).alias("shingles"))
            .withColumn("n_item", F.size("shingles")).filter("n_item > 0")
            .withColumn("part", F.ceil(F.log2("n_item")).cast("int")))
    largest = sets.groupBy("part").agg(F.max("n_item").alias("most"))
    k = (F.col("most") - F.ceil(F.col("most") * PERCENT / 100) + 1).cast("int")
    return sets.join(largest, "part").select("i_id", "i_text", "n_item", "shingles",
                                             F.slice("shingles", 1, k).alias("sketch"))


def hash_filter(hashes: DataFrame) -> DataFrame:
    """One row with one array<bigint> of ``FILTER_BITS`` bits, set at the ``hashes`` (h)."""
    slot = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    filled = (hashes.select(F.shiftright(slot, 6).alias("word"), F.pmod(slot, F.lit(64)).cast("int").alias("bit"))
              .groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")))
    every = hashes.sparkSession.range(FILTER_BITS // 64).withColumnRenamed("id", "word")
    rows = every.join(filled, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    ordered = rows.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all"))
    return ordered.select(F.transform("all", lambda x: x["bits"]).alias("bits"))


def passes(h: Column, bits: Column) -> Column:
    slot = F.pmod(h, F.lit(FILTER_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    return F.get(bits, F.shiftright(slot, 6).cast("int")).bitwiseAND(one) != 0


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(k_id, k_text, item_id, n_item, n_shared): one row for each document and item it contains.

    Texts of fewer than five words are one shingle of all their words; null,
    empty and blank texts contain nothing and are contained nowhere. Repeated
    rows (same id, same text) of either table count once; items that share an
    id but not the text are searched one by one. Other columns are not read. An
    empty table on either side gives an empty result.
    """
    parts = materialise(item_shingles(items, item_id_col, item_text_col), "items")
    shingles = parts.select("i_id", "i_text", F.explode("shingles").alias("h"))
    sketch = parts.select("i_id", "i_text", F.explode("sketch").alias("h"))
    bits = materialise(hash_filter(shingles.select("h")), "filter").scalar()  # half a megabyte, a constant of the plan
    split, hashed = shingle_array(F.col(text_col))
    held = (docs.select(*row_key(id_col, text_col), split.alias("ws"))
            # outer, as explode would have Spark compute the array once more for a filter on its size
            .select("k_id", "k_text", F.explode_outer(hashed).alias("h")).filter(passes(F.col("h"), bits)))
    held = materialise(held.distinct(), "held")
    pairs = (held.join(sketch, "h").select("k_id", "k_text", "i_id", "i_text").distinct()
             .toDF("p_id", "p_text", "i_id", "i_text"))
    whole = shingles.toDF("s_id", "s_text", "s")
    shared = (pairs.join(held, (F.col("p_text") == F.col("k_text")) & F.col("p_id").eqNullSafe(F.col("k_id")))
              .join(whole, (F.col("s") == F.col("h")) & (F.col("s_text") == F.col("i_text")) &
                    F.col("s_id").eqNullSafe(F.col("i_id")))
              .groupBy("k_id", "k_text", "i_id", "i_text").agg(F.count("*").alias("n_shared")))
    sizes = parts.select(F.col("i_id").alias("n_id"), F.col("i_text").alias("n_text"), F.col("n_item").cast("long"))
    return (shared.join(sizes, (F.col("n_text") == F.col("i_text")) & F.col("n_id").eqNullSafe(F.col("i_id")))
            .filter(100 * F.col("n_shared") >= PERCENT * F.col("n_item"))
            .select("k_id", "k_text", F.col("i_id").alias("item_id"), "n_item", "n_shared"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the rows that contain an item."""
    return without_rows(docs, contaminated(docs, items).select("k_id", "k_text").distinct())


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _sql_shingles(name: str, id_col: str) -> str:
    return f"""{name}_w AS (
  SELECT {id_col}, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                                  '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {name}),
{name}_s AS (
  SELECT DISTINCT {id_col}, array_to_string(w[i:least(i + {SHINGLE - 1}, len(w))], ' ') AS s
  FROM {name}_w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS u(i) WHERE len(w) > 0)"""


@query("op7_decontaminate", f"""
WITH {_sql_shingles('documents', 'doc_id')},
{_sql_shingles('benchmark', 'item_id')},
n AS (SELECT item_id, count(*) AS n_item FROM benchmark_s GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM documents_s JOIN benchmark_s USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared FROM m JOIN n USING (item_id) WHERE 100 * n_shared >= {PERCENT} * n_item""")
def op7_decontaminate(spark, sf_dir):
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("k_id").alias("doc_id"), "item_id", "n_item", "n_shared")

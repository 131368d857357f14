"""Cleaning a corpus of documents in five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm import op03_quality, op04_bpe, op06_minhash, op07_decontaminate, op08_line_dedup
from linklens.llm.common import WORD, free_prefix, materialise, row_key, table, without_rows
from linklens.session import ensure_checkpoint_dir, ship_package


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps."""
    _ready(spark)
    return op03_quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated passages deleted; documents of which no word is left go. n_chars follows the text."""
    _ready(spark)
    p = free_prefix(docs)
    removed = f"{p}removed"
    out = op08_line_dedup.dedup_lines(docs, counts=(f"{p}lines", removed))
    changed = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast("bigint"))
                             .otherwise(F.col("n_chars")))
    emptied = (F.col(removed) > 0) & ~F.col("text").rlike(WORD)
    return changed.filter(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id (null last), then the least text hash."""
    _ready(spark)
    rows = materialise(op06_minhash.grouped_documents(docs).filter("comp IS NOT NULL").select("k_id", "k_text", "comp"),
                       "grouped")
    least = rows.groupBy("comp").agg(F.min(F.struct(F.col("k_id").isNull().alias("no_id"), "k_id", "k_text")).alias("r"))
    least = least.select(F.col("r.k_id").alias("l_id"), F.col("r.k_text").alias("l_text"))
    keys = rows.groupBy("k_id", "k_text").agg(F.count("*").alias("n"))
    same = (keys["k_text"] == least["l_text"]) & keys["k_id"].eqNullSafe(least["l_id"])
    gone = keys.join(least, same, "left_anti").select("k_id", "k_text")
    left = without_rows(docs, gone)
    # rows equal in id and text: one stays
    again = materialise(keys.filter("n > 1").join(least, same, "left_semi").select("k_id", "k_text"), "repeated")
    if again.isEmpty():
        return left
    p = free_prefix(docs)
    key = [f"{p}id", f"{p}text"]
    own = docs.select("*", *[c.alias(n) for c, n in zip(row_key("doc_id", "text"), key, strict=True)])
    one = (own.join(again, (own[key[1]] == again["k_text"]) & own[key[0]].eqNullSafe(again["k_id"]), "left_semi")
           .dropDuplicates(key).select(*docs.columns))
    return without_rows(left, again).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    _ready(spark)
    return op07_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every document left; the digest is of the text decoded from the ids."""
    _ready(spark)
    names = op04_bpe.compile_lexicon(docs, op04_bpe.default_tokenizer())
    out = op04_bpe.encode_documents(docs, names, decode=True)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                      F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: Neither the quality model nor the encoder can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again for the next."""
    _ready(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

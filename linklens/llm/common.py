"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.session import ensure_checkpoint_dir

#: Characters that separate words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its DuckDB oracle if SQL can express it."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files every executor can read, so a lost executor
    costs a re-read, not a recomputation, and branches do not run it twice.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """(id, hash of the text): names a row; rows equal in both are copies and get equal results."""
    return [F.col(id_col).alias("k_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k_text")]


def words(text: Column) -> Column:
    """Words of a text as an array; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def free_prefix(*frames: DataFrame) -> str:
    """A prefix for helper columns that no column of ``frames`` has, in any case of letters."""
    prefix = "ll_"
    while any(c.lower().startswith(prefix) for df in frames for c in df.columns):
        prefix = f"l{prefix}"
    return prefix


def without_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose key is in ``keys`` (k_id, k_text), all columns as they are."""
    names, p = docs.columns, free_prefix(docs)
    own = docs.select("*", *[c.alias(f"{p}{n}") for c, n in zip(row_key(id_col, text_col), ("id", "text"), strict=True)])
    gone = keys.select(F.col("k_id").alias(f"{p}gone_id"), F.col("k_text").alias(f"{p}gone_text"))
    return own.join(gone, (F.col(f"{p}text") == F.col(f"{p}gone_text")) & F.col(f"{p}id").eqNullSafe(F.col(f"{p}gone_id")),
                    "left_anti").select(*names)

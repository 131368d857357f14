"""A link table that changes shard by shard: copy on write with a manifest for each version.

Below the table's root, ``data/v=<n>/shard=<s>`` holds a shard as version n left it, and ``manifest/v=<n>`` has
one row for each shard with rows: the version whose files are the shard's content, and its rows. A commit
writes only the shards it touches and then the manifest, whose own success file publishes
the version: readers see the whole of it or nothing. A commit is made from the version before
it alone, so one that is repeated after a lost driver or executor writes the same
again and counts once. Files that no kept manifest names are removed by :meth:`vacuum`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linklens.functions.codecs import shard_for
from linklens.sources.links_io import with_shard

MANIFEST = "shard int, version bigint, rows bigint"


class VersionedLinks:
    """Sharded link table at ``root``; ``shards`` and ``schema`` (without the shard column) are fixed."""

    def __init__(self, spark: SparkSession, root: str, shards: int, schema: T.StructType) -> None:
        self.spark, self.root, self.shards, self.schema = spark, root.rstrip("/"), shards, schema

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions, ascending."""
        fs, folder = self._files(), self._path("manifest")
        if not fs.exists(folder):
            return []
        names = [str(s.getPath().getName()) for s in fs.listStatus(folder)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(self._path("manifest", n, "_SUCCESS")))

    def manifest(self, version: int | None = None) -> list[tuple[int, int, int]]:
        """(shard, version of its files, rows) of a version (the newest); at most one for each shard."""
        version = self.versions()[-1] if version is None else version
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={version}").collect()
        return sorted((r["shard"], r["version"], r["rows"]) for r in rows)

    def read(self, version: int | None = None, shards: set[int] | None = None) -> DataFrame:
        """The table as a version left it, with its shard column; only the folders of ``shards`` if given."""
        wanted = [(s, v) for s, v, _ in self.manifest(version) if shards is None or s in shards]
        full = T.StructType([*self.schema.fields, T.StructField("shard", T.IntegerType())])
        if not wanted:
            return self.spark.createDataFrame([], full)
        paths = [f"{self.root}/data/v={v}/shard={s}" for s, v in wanted]
        found = self.spark.read.schema(T.StructType([*full.fields, T.StructField("v", T.LongType())]))
        return found.option("basePath", f"{self.root}/data").parquet(*paths).select(*full.names)

    def create(self, links: DataFrame) -> int:
        """Version 0: all of ``links``; an error where there is a table already."""
        if self.versions():
            raise ValueError(f"there is a table at {self.root}")
        return self._publish(0, with_shard(links.select(*self.schema.names), self.shards), [], set(range(self.shards)))

    def commit(self, version: int, touched: set[int], change: Callable[[DataFrame], DataFrame]) -> int:
        """Publish ``version``: the rows of the ``touched`` shards go through ``change``, other shards keep their files.

        ``change`` gets and returns rows of the table; a row whose code falls in
        a shard that is not touched is an error of the caller and fails the commit.
        """
        before = [x for x in self.manifest(version - 1) if x[0] not in touched]
        if not touched:
            return self._publish(version, None, before, touched)
        changed = with_shard(change(self.read(version - 1, touched)).select(*self.schema.names), self.shards)
        stray = F.raise_error(F.concat(F.lit("not a touched shard: "), F.col("shard").cast("string"))).cast("int")
        kept = F.when(F.col("shard").isin(sorted(touched)), F.col("shard")).otherwise(stray)
        return self._publish(version, changed.withColumn("shard", kept), before, touched)

    def _publish(self, version: int, rows: DataFrame | None, kept: list, touched: set[int]) -> int:
        new, folder = [], f"{self.root}/data/v={version}"
        if rows is not None:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            spread = F.pmod(F.xxhash64("code"), F.lit(max(1, parts // max(1, len(touched)))))
            (rows.repartition(parts, F.col("shard"), spread).sortWithinPartitions("shard", F.desc("created_at"), F.desc("id"))
             .write.mode("overwrite").partitionBy("shard").parquet(folder))
            counted = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("shard", T.IntegerType())])).parquet(folder)
            new = [(r["shard"], version, r["n"]) for r in counted.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
        listed = self.spark.createDataFrame([*kept, *new], MANIFEST).coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
        return version

    def vacuum(self, keep: int = 2) -> list[int]:
        """Remove manifests but the newest ``keep`` and the files that no kept one names; the versions whose files went."""
        fs, known = self._files(), self.versions()
        for v in known[:-keep]:
            fs.delete(self._path("manifest", f"v={v}"), True)
        named = {(s, v) for kept in known[-keep:] for s, v, _ in self.manifest(kept)}
        gone = []
        for v in range(known[-1] + 1):
            if not fs.exists(self._path("data", f"v={v}")):
                continue
            if all(x[1] != v for x in named):
                fs.delete(self._path("data", f"v={v}"), True)
                gone.append(v)
            else:
                for s in range(self.shards):
                    if (s, v) not in named and fs.exists(self._path("data", f"v={v}", f"shard={s}")):
                        fs.delete(self._path("data", f"v={v}", f"shard={s}"), True)
        return gone


def shards_of(codes: DataFrame, shards: int, code_col: str = "code") -> set[int]:
    """Shards of the codes: at most ``shards`` numbers."""
    return {r[0] for r in codes.select(shard_for(code_col, shards).cast("int")).distinct().collect()}


def reap(table: VersionedLinks, now_ms: int) -> tuple[int, DataFrame]:
    """Remove expired links as a new version; (version, report (shard, expired, kept, rewritten) of the version before).

    Expiry is counted for each shard first; shards without an expired link keep
    their files. A link whose expiry is ``now`` is expired, one without expiry never is.
    """
    last = table.versions()[-1]
    expired = F.col("expires_at") <= F.lit(now_ms)
    counts = table.read(last).groupBy("shard").agg(
        F.count_if(F.coalesce(expired, F.lit(False))).alias("expired"),
        F.count_if(~F.coalesce(expired, F.lit(False))).alias("kept")).collect()  # one row a shard
    touched = {r["shard"] for r in counts if r["expired"]}
    version = table.commit(last + 1, touched, lambda rows: rows.where(F.col("expires_at").isNull() | ~expired))
    report = table.spark.createDataFrame([(r["shard"], r["expired"], r["kept"], r["shard"] in touched) for r in counts],
                                         "shard int, expired bigint, kept bigint, rewritten boolean")
    return version, report

"""Near-duplicate groups: banded MinHash, sequential Bayesian pruning, exact verification.

1. Texts with equal shingle sets are one class (copies never meet in pairs).
2. Signatures of classes are cut into bands; classes that share a band are candidates.
3. In a bucket all members meet one pivot, in two rounds; the pivot is the member with the most links so far, so the
   text that a group was copied from soon is one.
4. Members of buckets that still hold several components meet where their sets can be similar enough at all: each set's
   shingles are ordered by how many of these sets have them, the rarest first, and two sets of different components
   meet on a shingle that stands early in both, if their sizes and what follows it leave a link possible. Two
   sets that are linked always share such a shingle, so no link is lost, and the pairs do not grow with a bucket's square.
5. Pairs compare signatures batch by batch and stop as soon as the posterior
   probability of a similarity of ``THRESHOLD`` falls under ``MISS``.
6. Survivors are compared on their full shingle sets; links become components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linklens.llm.common import materialise, query, row_key, table
from linklens.llm.components import merge_components
from linklens.llm.shingles import WordHashes, hash_family, minhash, shingle_hashes, split_words

#: Similarity of a link in percent: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: 48 bands of 5 rows: a pair at 0.75 shares no band with probability 2.3e-6.
BANDS, ROWS = 48, 5
HASHES = BANDS * ROWS
#: Hashes compared at a time, and the chance of a link at which a pair is dropped.
BATCH, MISS = 40, 1e-6
#: Rounds of pivots.
PIVOTS = 2
#: Bits of the filter that spares unneeded texts a shuffle (1 MB, whatever the input).
FILTER_BITS = 1 << 23


def least_matches(batch: int = BATCH, hashes: int = HASHES, percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For n = batch, 2 * batch, ...: matches under which P(similarity >= percent) < miss.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose tail beyond t is the
    chance of at most m successes in n + 1 trials of probability t.
    """
    t, found = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        found.append(m)
    return found


def sign_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k_id, k_text, n_shingles, set_key (digest of the whole set), sig of every row."""
    family = hash_family(HASHES)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            sizes, keys, sigs = [], [], []
            for text in pdf["text"]:
                s = shingle_hashes(split_words(text), hashes)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(minhash(s, family).tobytes() if len(s) else b"")
            yield pd.DataFrame({"k_id": pdf["k_id"], "k_text": pdf["k_text"], "n_shingles": sizes, "set_key": keys,
                                "sig": sigs})

    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    packed = rows.withColumn("k_id", F.col("k_id").cast("string"))
    out = packed.mapInPandas(sign, "k_id string, k_text bigint, n_shingles bigint, set_key binary, sig binary")
    return out.withColumn("k_id", F.col("k_id").cast(docs.schema[id_col].dataType))


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, node): a key for every band of every class."""

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salts = np.arange(1, BANDS + 1, dtype=np.uint64)
        for pdf in batches:
            sig = np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(len(pdf), BANDS, ROWS)
            yield pd.DataFrame({"key": mix_rows(sig, salts).ravel().view(np.int64),
                                "node": np.repeat(pdf["node"].to_numpy(), BANDS)})

    return classes.select("node", "sig").mapInPandas(bands, "key bigint, node bigint")


def mix_rows(rows: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """64-bit keys of the last axis of ``rows``, one salt for each place on the axis before."""
    p, q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
    key = np.broadcast_to(salts * q, rows.shape[:-1]).copy()
    for k in range(rows.shape[-1]):
        key = (key ^ rows[..., k]) * p
        key ^= key >> np.uint64(29)
    return key * q


def shared_buckets(keys: DataFrame) -> DataFrame:
    """(key, node) of the keys that two classes or more have."""
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key", "left_semi")


def probable_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose signatures leave a link possible, compared batch by batch."""
    floors = least_matches()

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = (np.frombuffer(b"".join(pdf[c]), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
            for step, floor in enumerate(floors):
                at = slice(step * BATCH, (step + 1) * BATCH)
                matches = matches + (a[alive, at] == b[alive, at]).sum(axis=1)
                keep = matches >= floor
                alive, matches = alive[keep], matches[keep]
            yield pdf.iloc[alive][["a", "b"]]

    signed = pairs
    for side in ("a", "b"):
        signed = signed.join(classes.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}")), side)
    return signed.select("a", "b", "sig_a", "sig_b").mapInPandas(prune, "a bigint, b bigint")


def shingle_sets(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the ``needed`` (k_id, k_text, node), computed from the texts anew.

    A bit filter of the needed text hashes (a fixed 1 MB) lets most other texts
    go before the join; where it fills up, more rows reach the join and no more.
    """
    slot = F.pmod(F.col("k_text"), F.lit(FILTER_BITS)) + 1  # Spark's bitmap functions count from 1
    bits = (needed.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect())
    wanted = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits:  # at most 256 rows of 4 KB
        wanted[(r["bucket"] - 1) * 4096:r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            place = np.mod(pdf["k_text"].to_numpy(), FILTER_BITS)
            part = pdf[(wanted[place // 8] >> (place % 8).astype(np.uint8)) & 1 == 1]
            sets = [shingle_hashes(split_words(t), hashes).tobytes() for t in part["text"]]
            yield pd.DataFrame({"k_id": part["k_id"], "k_text": part["k_text"], "shingles": sets})

    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    packed = rows.withColumn("k_id", F.col("k_id").cast("string"))
    sets = packed.mapInPandas(compute, "k_id string, k_text bigint, shingles binary")
    ids = needed.select(F.col("k_id").cast("string").alias("n_id"), F.col("k_text").alias("n_text"), "node")
    found = sets.join(ids, (sets["k_text"] == ids["n_text"]) & sets["k_id"].eqNullSafe(ids["n_id"]))
    return found.select("node", "shingles")


def exact_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that reach ``PERCENT`` on their full sets."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["set_a"], pdf["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]

    full = pairs
    for side in ("a", "b"):
        full = full.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    return full.select("a", "b", "set_a", "set_b").mapInPandas(verify, "a bigint, b bigint")


def member_shingles(sets: DataFrame) -> DataFrame:
    """(node, n, h): every shingle of every set (node, shingles) and the set's size."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):  # a few sets at a time bound the memory
                part = pdf.iloc[at:at + 64]
                own = [np.frombuffer(x, np.int64) for x in part["shingles"]]
                sizes = np.array([len(x) for x in own], np.int64)
                yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), sizes), "n": np.repeat(sizes, sizes),
                                    "h": np.concatenate(own) if own else np.empty(0, np.int64)})

    return sets.select("node", "shingles").mapInPandas(spread, "node bigint, n bigint, h bigint")


def early_shingles(rows: DataFrame) -> DataFrame:
    """(node, n, h, pos) of the shingles by which a set can meet another: the first n - ceil(0.75 n) + 1 in the order of
    (number of sets that have it, hash).

    A shingle of one set only comes first and meets nothing, so it is counted, not kept.
    """
    common = rows.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1")
    shared = rows.join(common, "h")
    in_order = Window.partitionBy("node").orderBy("df", "h")
    placed = shared.select("node", "n", "h", (F.row_number().over(in_order) - 1).alias("rank"),
                           F.count("*").over(Window.partitionBy("node")).alias("kept"))
    pos = F.col("rank") + F.col("n") - F.col("kept")
    return placed.withColumn("pos", pos.cast("bigint")).filter(
        F.col("pos") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100)).select("node", "n", "h", "pos")


def similar_pairs(early: DataFrame) -> DataFrame:
    """(a, b): members (node, comp, n, h, pos) of different components that share an early shingle and can be linked.

    With sizes x and y a link needs an intersection of PERCENT * (x + y) / (100 + PERCENT). The shingle must stand
    among the first y - ceil(2 * PERCENT * y / (100 + PERCENT)) + 1 of the smaller set, and what stands from it on in
    both must suffice. Of each shingle, the component with the most members there does not meet itself.
    """
    parts = early.groupBy("h", "comp").agg(F.count("*").alias("c"))
    main = parts.groupBy("h").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps")).filter("comps > 1")
    met = materialise(early.join(main.select("h", F.col("m.comp").alias("main")), "h"), "early")
    x = met.filter("comp <> main").select("h", *[F.col(c).alias(f"{c}_x") for c in ("node", "comp", "n", "pos")])
    y = met.select("h", *[F.col(c).alias(f"{c}_y") for c in ("node", "comp", "n", "pos")])
    both = F.col("n_x") + F.col("n_y")
    x_small = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") < F.col("node_y")))
    small_n, small_pos = F.when(x_small, F.col("n_x")).otherwise(F.col("n_y")), F.when(x_small, F.col("pos_x")).otherwise(F.col("pos_y"))
    rest = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
    able = ((100 * small_n >= PERCENT * F.greatest("n_x", "n_y"))
            & ((100 + PERCENT) * (small_n - small_pos) >= 2 * PERCENT * small_n)
            & ((100 + PERCENT) * rest >= PERCENT * both))
    return (x.join(y, "h").filter((F.col("comp_x") != F.col("comp_y")) & able)
            .select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")))


def _with_comps(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _pivot_pairs(members: DataFrame, linked: list[DataFrame]) -> DataFrame:
    """(a, b): each bucket's pivot and its members of other components."""
    ranked = members.withColumn("degree", F.lit(0).cast("bigint"))
    if linked:
        links = reduce(DataFrame.unionByName, linked)
        ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
        degrees = ends.groupBy("node").agg(F.count("*").alias("degree"))
        ranked = members.join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    pivots = (ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), "comp")).alias("p"))
              .select("key", (-F.col("p.minus")).alias("pivot"), F.col("p.comp").alias("pivot_comp")))
    return (members.join(pivots, "key").filter("comp <> pivot_comp")
            .select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: k_id, k_text (its key), n_shingles, component_id, kept.

    component_id is the least id of the component; ids that are null count only
    where no other is there. Null, empty and blank texts have no shingle and are
    their own component. Repeated rows (same id, same text) get equal results.
    Other columns are not read. An empty table gives an empty result.
    """
    return grouped_documents(docs, id_col, text_col).drop("comp").withColumn(
        "kept", F.col("k_id").eqNullSafe(F.col("component_id")))


def grouped_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k_id, k_text, n_shingles, component_id, comp of every row; comp: a number for each component, null without shingles.

    Where ids are null or repeated, several components can have one component_id, but not one comp.
    """
    signed = materialise(sign_documents(docs, id_col, text_col), "signed")
    # one row per class; its least (id, text hash) names the text to read for its set
    classes = materialise(
        signed.filter("n_shingles > 0").groupBy("set_key")
        .agg(F.min("k_id").alias("least_id"), F.min(F.struct("k_id", "k_text")).alias("rep"), F.first("sig").alias("sig"))
        .select(F.monotonically_increasing_id().alias("node"), "set_key", "least_id", "rep.k_id", "rep.k_text", "sig"),
        "classes")
    members = materialise(shared_buckets(band_keys(classes)), "buckets")
    # most classes share no bucket; the signatures of the others move on their own
    met = materialise(classes.select("node", "k_id", "k_text", "sig").join(members.select("node").distinct(), "node",
                                                                           "left_semi"), "met")
    labels, linked = None, []

    def sets_of(nodes: DataFrame, name: str) -> DataFrame:
        needed = materialise(met.select("node", "k_id", "k_text").join(nodes, "node"), "needed")
        return materialise(shingle_sets(docs, needed, id_col, text_col).dropDuplicates(["node"]), name)

    def link(pairs: DataFrame, sets: DataFrame | None = None) -> bool:
        """Verify ``pairs`` (a, b) and add their links; whether there were any."""
        nonlocal labels
        likely = materialise(probable_pairs(pairs.select("a", "b").distinct(), met), "likely")
        if likely.isEmpty():
            return False
        if sets is None:
            sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "sets")
        links = materialise(exact_links(likely, sets), "exact")
        if links.isEmpty():
            return False
        linked.append(links)
        labels = merge_components(labels, links)
        return True

    if not members.isEmpty():
        for _ in range(PIVOTS):
            if not link(_pivot_pairs(_with_comps(members, labels), linked)):
                break
        at = materialise(_with_comps(members, labels), "members")
        mixed = at.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most")
        open_nodes = materialise(at.join(mixed.select("key"), "key", "left_semi").select("node", "comp").distinct(), "open")
        sets = sets_of(open_nodes.select("node"), "open-sets")
        early = early_shingles(member_shingles(sets)).join(open_nodes, "node")
        link(similar_pairs(materialise(early, "prefixes")), sets)

    named = _with_comps(classes.select("set_key", "node", "least_id"), labels)
    if labels is not None:
        least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
        named = named.join(least, "comp")
    else:
        named = named.withColumn("component_id", F.col("least_id"))
    rows = signed.select("k_id", "k_text", "n_shingles", "set_key").join(
        named.select("set_key", "component_id", "comp"), "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("k_id"))
    return rows.select("k_id", "k_text", "n_shingles", component.alias("component_id"), "comp")


@query("op6_minhash")
def op6_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("k_id").alias("doc_id"), "n_shingles", "component_id", "kept")

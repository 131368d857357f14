"""Shards from a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring has ``PLACES`` places. Every shard has virtual nodes on it, every row hashes
to a place and belongs to the first node clockwise. A shard that has reached its bound
takes no more: the rows of its nodes that come after continue clockwise to the next
node of a shard with room. Rows overflow by whole runs of one arc, so where they go is
decided from the number of rows of each arc, and every row finds its shard and its slot
from its rank in its arc. Ranks come from counts at every level, so neither a hot place
nor any number of equal rows meets in one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linklens.llm.common import materialise, query, table

SHARDS, VIRTUAL = 40, 64
#: Places of the ring: four hexadecimal digits of a digest.
DIGITS = 4
PLACES = 16**DIGITS
#: A row's size is its bytes and this (fixed value of the contract).
OVERHEAD = 16
#: Equal rows are numbered in runs of so many consecutive rows of the written table.
RUN_BITS = 16


def ring(shards: int = SHARDS, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise; a node stays where it is when shards are added."""
    return sorted((int(hashlib.md5(f"node:{s}:{r}".encode()).hexdigest()[:DIGITS], 16), s)
                  for s in range(shards) for r in range(virtual))


def bounds(rows: int, shards: int = SHARDS, slack: float = 0.0) -> list[int]:
    """Most rows of each shard. Without slack they add up to all rows, and counts differ by one at most."""
    if slack > 0:
        return [int(-(-rows * (1 + slack) // shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def flow(nodes: list[tuple[int, int]], counts: dict[int, int], most: list[int]) -> dict[int, list[tuple[int, int, int, int]]]:
    """arc -> [(first rank, rank after the last, shard, slot of the first)].

    In each round the runs that wait at a shard's nodes enter in the order of (node,
    arc, rank) until the shard is full; what is left goes on to the next node clockwise
    of a shard that has room. Every round that leaves something fills a shard, so there
    are at most as many rounds as shards. Reads one count for each virtual node, however
    many rows there are.
    """
    used, placed = [0] * len(most), defaultdict(list)
    waiting = [(arc, arc, 0, n) for arc, n in sorted(counts.items()) if n]
    while waiting:
        left = []
        for node, arc, lo, hi in sorted(waiting):
            shard = nodes[node][1]
            take = min(hi - lo, most[shard] - used[shard])
            if take:
                placed[arc].append((lo, lo + take, shard, used[shard]))
                used[shard] += take
            if take < hi - lo:
                left.append((node, arc, lo + take, hi))
        room = [i for i, (_, s) in enumerate(nodes) if used[s] < most[s]]
        waiting = [(room[bisect_right(room, node) % len(room)], arc, lo, hi) for node, arc, lo, hi in left]
    return placed


def places_of(spark: SparkSession, nodes: list[tuple[int, int]]) -> DataFrame:
    """(place, arc): the arc of a place is the first node there or after it, clockwise."""
    starts = [0, *[place + 1 for place, _ in nodes]]
    arcs = [(i, a, place) for i, (a, (place, _)) in enumerate(zip(starts, nodes, strict=False)) if a <= place]
    arcs.append((0, nodes[-1][0] + 1, PLACES - 1))
    return (spark.createDataFrame([x for x in arcs if x[1] <= x[2]], "arc int, lo int, hi int")
            .select(F.explode(F.sequence("lo", "hi")).alias("place"), "arc"))


def row_digest(id_col: Column, size: Column, crc: Column) -> Column:
    """Digest that sets a row's place and its order there: of its id and of its text's length and checksum."""
    return F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("-")), size.cast("string"),
                             F.coalesce(crc.cast("string"), F.lit("-"))).cast("binary"))


def ring_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, crc, place, pos, run, tag) of every row, written: the texts are read once, and tag names a row for good."""
    text, crc, size = F.col(text_col).cast("string"), F.col("crc"), F.col("size")
    digest = F.col("digest")
    return materialise(
        docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
                    F.crc32(text.cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("tag"))
        .withColumn("digest", row_digest(F.col("id"), size, crc))
        .select("id", "size", "crc", F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("int").alias("place"),
                F.conv(F.substring(digest, DIGITS + 1, 15), 16, 10).cast("bigint").alias("pos"),
                F.shiftright("tag", RUN_BITS).alias("run"), "tag"), "ring-rows")


def place_ranks(rows: DataFrame) -> DataFrame:
    """``rows`` with rank: 0, 1, ... among the rows of a place, in the order (pos, crc, size, run, tag).

    Rows equal in (pos, crc, size) are copies of one row; a run holds at most
    2 ** RUN_BITS of them, and a place is ordered by its runs' counts.
    """
    same = ["place", "pos", "crc", "size", "run"]
    runs = rows.groupBy(*same).agg(F.count("*").alias("n"))
    before = Window.partitionBy("place").orderBy(*same[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(*[F.col(c).alias(f"r_{c}") for c in same], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy("tag")))
    equal = [numbered[c].eqNullSafe(starts[f"r_{c}"]) if c == "crc" else numbered[c] == starts[f"r_{c}"] for c in same]
    met = equal[0]
    for e in equal[1:]:
        met = met & e
    return numbered.join(starts, met).select("id", "size", "crc", "place", (F.col("start") + F.col("nth") - 1).alias("rank"))


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                  virtual: int = VIRTUAL, slack: float = 0.0) -> DataFrame:
    """(id, size, crc, home, shard, slot) of every row of ``docs``; home: the shard of the row's own arc.

    A shard takes at most ceil((1 + slack) * rows / shards) rows; without slack the bounds
    add up to the number of rows and counts differ by one at most. slot: 0, 1, ... in
    each shard. Null and empty texts have no bytes, a null text no crc; null ids are one
    more id. Repeated rows each get a slot of their own, which of them is which is
    arbitrary. Texts of any length are only measured and hashed. An empty table gives an
    empty result. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    nodes = ring(shards, virtual)
    rows = ring_rows(docs, id_col, text_col)
    # at most PLACES rows from here on
    spots = places_of(spark, nodes).join(rows.groupBy("place").agg(F.count("*").alias("n")), "place", "left")
    spots = spots.select("place", "arc", F.coalesce("n", F.lit(0)).alias("n"))
    # the first arc also holds the places after the last node, which come before the others, clockwise
    turn = F.when((F.col("arc") == 0) & (F.col("place") > nodes[0][0]), F.col("place") - PLACES).otherwise(F.col("place"))
    before = Window.partitionBy("arc").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    spots = materialise(spots.select("place", "arc", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "spots")
    counts = {r["arc"]: r["n"] for r in spots.groupBy("arc").agg(F.sum("n").alias("n")).collect()}  # one row a node
    placed = flow(nodes, counts, bounds(sum(counts.values()), shards, slack))
    runs = spark.createDataFrame([(arc, nodes[arc][1], placed.get(arc, [])) for arc in range(len(nodes))],
                                 "arc int, home int, runs array<struct<lo: bigint, hi: bigint, shard: int, slot: bigint>>")
    at = F.col("before") + F.col("rank")
    # both sides that are broadcast are bounded by the ring: PLACES rows, and one row a node
    return (place_ranks(rows).join(F.broadcast(spots.select("place", "arc", "before")), "place")
            .select("id", "size", "crc", "arc", at.alias("rank")).join(F.broadcast(runs), "arc")
            .withColumn("run", F.get(F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"])), F.lit(0)))
            .select("id", "size", "crc", "home", "run.shard",
                    (F.col("run.slot") + F.col("rank") - F.col("run.lo")).alias("slot")))


#: CTE with the 256 steps of a CRC-32, from its polynomial.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([c, 1, 2, 3, 4, 5, 6, 7, 8],
                          lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY c) AS t
  FROM (SELECT range::BIGINT AS c FROM range(256)))"""


def crc32_sql(text: str) -> str:
    """DuckDB expression over ``crc_table``: the CRC-32 of a text's UTF-8 bytes, null for null."""
    return f"""CASE WHEN {text} IS NULL THEN NULL ELSE xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1]))) END"""


_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
base AS (
  SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + {OVERHEAD})::BIGINT AS size,
         {crc32_sql('text')} AS text_crc32
  FROM documents, crc_table),
digests AS (
  SELECT *, md5(coalesce(doc_id::VARCHAR, '-') || ':' || size || ':' || coalesce(text_crc32::VARCHAR, '-')) AS m FROM base),
keyed AS (
  SELECT doc_id, size, text_crc32, ('0x' || m[1:{DIGITS}])::INTEGER AS place,
         ('0x' || m[{DIGITS + 1}:{DIGITS + 15}])::BIGINT AS pos FROM digests),
nodes AS (
  SELECT row_number() OVER (ORDER BY place, shard) - 1 AS node, place, shard
  FROM (SELECT ('0x' || md5('node:' || s.range || ':' || r.range)[1:{DIGITS}])::INTEGER AS place, s.range AS shard
        FROM range({SHARDS}) s, range({VIRTUAL}) r)),
arcs AS (
  SELECT k.*, coalesce((SELECT min(node) FROM nodes n WHERE n.place >= k.place), 0) AS arc FROM keyed k),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY arc ORDER BY arc = 0 AND place <= (SELECT min(place) FROM nodes), place, pos,
                               text_crc32, size, doc_id) - 1 AS rank FROM arcs),
moves(kind, arc, lo, hi, node, shard, used, free) AS (
  SELECT 'waits', arc, 0::BIGINT, count(*)::BIGINT, arc, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM ranked GROUP BY arc
  UNION ALL
  SELECT 'shard', NULL, NULL, NULL, NULL, s.range, 0,
         (SELECT count(*) FROM ranked) // {SHARDS} + (s.range < (SELECT count(*) FROM ranked) % {SHARDS})::INT FROM range({SHARDS}) s
  UNION ALL
  (WITH met AS (
     SELECT w.arc, w.lo, w.hi, w.node, n.shard, s.used, s.free,
            sum(w.hi - w.lo) OVER (PARTITION BY n.shard ORDER BY w.node, w.arc, w.lo) - (w.hi - w.lo) AS ahead
     FROM moves w JOIN nodes n ON w.node = n.node JOIN moves s ON s.kind = 'shard' AND s.shard = n.shard WHERE w.kind = 'waits'),
   taken AS (SELECT *, least(hi - lo, greatest(0, free - ahead)) AS take FROM met),
   full_now AS (
     SELECT s.shard, s.used + coalesce(sum(t.take), 0) AS used, s.free - coalesce(sum(t.take), 0) AS free
     FROM moves s LEFT JOIN taken t ON t.shard = s.shard WHERE s.kind = 'shard' GROUP BY s.shard, s.used, s.free),
   left_over AS (SELECT arc, lo + take AS lo, hi, node FROM taken WHERE take < hi - lo),
   room AS (SELECT n.node FROM nodes n JOIN full_now f ON n.shard = f.shard WHERE f.free > 0)
   SELECT 'placed', arc, lo, lo + take, NULL, shard, used + ahead, NULL FROM taken WHERE take > 0
   UNION ALL
   SELECT 'shard', NULL, NULL, NULL, NULL, shard, used, free FROM full_now WHERE EXISTS (FROM left_over)
   UNION ALL
   SELECT 'waits', l.arc, l.lo, l.hi, arg_min(r.node, (r.node - l.node - 1 + {SHARDS * VIRTUAL}) % {SHARDS * VIRTUAL}), NULL, NULL, NULL
   FROM left_over l, room r GROUP BY l.arc, l.lo, l.hi, l.node))
SELECT r.doc_id, r.size, r.text_crc32, 'rows' AS law, m.shard::INTEGER AS shard, (m.used + r.rank - m.lo)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM ranked r JOIN moves m ON m.kind = 'placed' AND m.arc = r.arc AND r.rank >= m.lo AND r.rank < m.hi
"""


@query("op12_sharding", _SQL)
def op12_sharding(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
